"""Training-data operators: deduplication, filtering, search, mixing, packing.

Nothing else in the library imports this subpackage; it can be removed whole.
"""
