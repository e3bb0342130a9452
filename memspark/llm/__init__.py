"""Training-data operators (sharding, deduplication, filtering, mixing, formatting).

Nothing else in the library imports this subpackage.
"""
