"""Training-data operators: media columns, tokenisation, language and quality filters, sharding, search, mixing, joins.

Nothing outside this subpackage imports it.
"""
