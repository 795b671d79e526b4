"""Operators of a training-data pipeline: counting, scanning, filtering,
near-duplicates, encoding, sharding and mixing of documents. Nothing else
in the library imports this subpackage."""
