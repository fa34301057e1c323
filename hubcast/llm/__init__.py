"""Operators for preparing language-model training data (documents, vectors).

Every operator is a function ``DataFrame (+ parameters) -> DataFrame``.  Nothing
outside this package imports it; ``queries.py`` holds its registered queries.
"""
