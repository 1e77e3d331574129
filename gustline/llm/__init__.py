"""Training-data operators: near-duplicates, spans, filters, search, tokens and packing.

Nothing else in the library imports this subpackage.
"""
