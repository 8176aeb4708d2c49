"""Operators of a training-data pipeline: near duplicates, search, packing, mixing, filters, archives.

Nothing else in the library imports this subpackage."""
