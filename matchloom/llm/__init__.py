"""Training-data operators: sharding, near-duplicates, language, packing, extraction, screening.

Nothing outside this subpackage imports it.  ``queries`` holds the thin registered
queries and ``sql`` their DuckDB statements; every other module is one operator.
"""
