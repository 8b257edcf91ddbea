"""Training-data operators: search, dedup, extraction, filters, packing and tokenizing.

Nothing else in the library imports this subpackage.
"""
