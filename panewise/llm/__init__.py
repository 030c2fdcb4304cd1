"""Operators for large-scale training-data pipelines.

Nothing outside this subpackage (and the entry point that registers its
queries) imports it.
"""
