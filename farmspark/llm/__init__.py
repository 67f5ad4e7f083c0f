"""Training-data operators: dedup, packing, scoring, scanning and mixing.

Every operator takes and returns DataFrames; ``queries.py`` registers the
contract queries and their DuckDB statements.  Nothing outside this package
imports it.
"""
