"""Operators of a training-data pipeline (packing, sharding, search, scans,
decontamination, deduplication, filters).  Nothing else in the library
imports this subpackage."""
