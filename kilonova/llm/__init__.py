"""Operators for preparing training text at corpus scale (one module per operator).

Nothing else in the library imports this package; ``queries`` registers one query per operator and the
pipeline of ``corpus_pipeline.py``.
"""
