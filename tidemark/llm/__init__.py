"""Training-data operators (language id, dedup, filters, tokenizing, packing, search).

Nothing outside this subpackage imports it.
"""
