"""Training-data operators: labelling, deduplication, formatting, mixing, search and packing.

Nothing else in the package imports this subpackage.
"""
