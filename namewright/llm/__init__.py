"""Operators for preparing training corpora.

Nothing outside this subpackage (and ``corpus_pipeline.py`` beside the package)
imports it; ``__spark_entry__.py`` adds ``registry.QUERIES`` when it is present.
"""
