"""Operators of a training-data pipeline, each a function between DataFrames.

Nothing outside this subpackage imports it.  ``queries.py`` binds the operators
to the given tables; ``corpus_pipeline.py`` at the repository top chains five of
them.
"""
