"""Operators for large-scale training-data pipelines.

One module per operator; ``queries`` registers the thin ``opN_<name>`` queries.
Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
