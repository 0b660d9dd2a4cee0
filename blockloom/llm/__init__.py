"""Training-data operators: token counts, media, deduplication, mixing, filters, packing, scoring.

Nothing else in the library imports this subpackage. ``queries.py`` holds the registered
queries, one per operator, and their DuckDB oracles where SQL can express them.
"""
