"""Training-data operators: filtering, deduplication, tokenising and packing of document corpora.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it; it may be removed without
touching the rest of the library.
"""
