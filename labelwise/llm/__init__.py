"""Operators of a training-data pipeline: cleaning, de-duplication, extraction and encoding of large text tables.

Nothing outside this subpackage imports it.  ``queries.py`` holds the registered queries and their SQL oracles.
"""
