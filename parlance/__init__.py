"""parlance: speech-corpus preparation as Spark DataFrame jobs.

Public functions take and return ``DataFrame`` or ``Column``. Row-local
work is expressed with built-in Spark SQL functions; the only Python that
runs in executors is the high-pass filter in ``functions.signal``.
"""

__version__ = "0.1.0"
