"""Shared plan pieces (dedup, paging, traversal, range join) and the query registry."""
