"""Training-data operators: scoring, deduplication, tokenization, packing, filtering.

Nothing else in the package imports this subpackage; it can be removed as a whole.
"""
