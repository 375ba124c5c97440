"""Operators for preparing language-model training data.

Nothing outside this package (but ``corpus_pipeline.py`` and the guarded import
in ``__spark_entry__.py``) depends on it.
"""
