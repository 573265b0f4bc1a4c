"""Training-data operators: extraction, filtering, deduplication, search, packing, tokenising and formatting.

Nothing outside this subpackage imports it. ``queries`` registers one query per operator.
"""
