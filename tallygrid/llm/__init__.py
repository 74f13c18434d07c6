"""Training-data operators: extraction, deduplication, filtering, mixing and sharding.

Nothing outside this subpackage imports it; ``queries.py`` holds the registered queries.
"""
