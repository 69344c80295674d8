"""Training-data operators: mixing, search, tokenising, deduplication, scoring.

Nothing outside this folder imports it. Each module holds one operator with a
general interface; ``queries.py`` holds the thin registered queries.
"""
