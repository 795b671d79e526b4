"""Sources and sinks: corpus scans, proxies, signals, stages, exports."""
