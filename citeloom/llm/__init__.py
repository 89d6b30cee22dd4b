"""Operators for preparing language-model training corpora.

Nothing outside this subpackage (and ``corpus_pipeline.py``, which counts as a part of it)
imports it; deleting it leaves the rest of the library whole.
"""
