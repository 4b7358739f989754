"""Operators on DataFrames: filters, grouping, paging, joins, search, vectors, lookup."""
