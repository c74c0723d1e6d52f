"""Training-data operators: scoring, de-duplication, filtering, tokenising, sharding.

Nothing outside this subpackage imports it; queries and SQL live in
``queries.py`` and ``oracle.py`` here.
"""
