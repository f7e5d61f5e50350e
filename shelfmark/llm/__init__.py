"""Operators for building training data from text, pages and vectors.

Nothing outside this folder imports it (``__spark_entry__.py`` adds its
queries only if it is there). One module per operator, ``queries.py`` with
the thin registered queries, ``common.py`` with what they share.
"""
