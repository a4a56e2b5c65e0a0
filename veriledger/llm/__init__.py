"""Training-data operators: scoring, filtering, deduplication, packing, archives.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
