"""Operators for large-scale training-data pipelines (dedup, classification, packing, search).

Self-contained: it uses general helpers of the library, and nothing outside this subpackage
imports it.
"""
