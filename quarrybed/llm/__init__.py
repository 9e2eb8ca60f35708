"""Training-data operators: dedup, packing, tokenising, filtering and classifying.

Nothing else in the library imports this subpackage.
"""
