"""Operators of a training-data pipeline: deduplication, scoring, formatting, mixing and sharding.

Nothing outside this package (and ``corpus_pipeline.py``) imports it, so it can be removed as a whole.
"""
