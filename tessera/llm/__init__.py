"""Corpus operators for training data: dedup, cleaning, tokenising, sharding.

Nothing outside this subpackage imports it; ``queries.py`` lists what it
offers to ``__spark_entry__.py``.
"""
