"""Incremental (streaming) variants of the row-local stages."""
