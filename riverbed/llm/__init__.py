"""Training-data operators: deduplication, tokens, packing, archives, quality.

Nothing else in the package imports this subpackage.
"""
