"""Training-data operators: token files, packing, filters, near-duplicates, shards.

Nothing else in the library imports this package. Each module holds one
operator with its own interface; ``catalog`` registers one query for each.
"""
