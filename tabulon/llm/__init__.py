"""Training-data operators: scoring, deduplication, decontamination, formatting, tokenising.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
