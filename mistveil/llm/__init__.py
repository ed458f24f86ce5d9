"""Training-data operators: mixing, deduplication, filtering, scoring and archives.

Nothing else in the library imports this subpackage.
"""
