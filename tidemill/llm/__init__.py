"""Training-data operators: token counts, encoding, deduplication, filtering, mixing, search.

Nothing else in the library imports this subpackage.
"""
