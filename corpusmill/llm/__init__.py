"""Training-data operators: packing, deduplication, scoring, archives, tokens, vectors, media and languages.

Nothing else in the package imports this subpackage.
"""
