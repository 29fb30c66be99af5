"""Training-data operators: near-duplicates, quality models, packing, search.

Nothing outside this subpackage imports it.  ``paperloom.llm.queries`` holds the
contract queries and their SQL.
"""
