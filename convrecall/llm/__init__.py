"""Operators for training-data pipelines: formatting, deduplication, mixing, search, filtering, tokenising.

Nothing else in the library imports this subpackage.
"""
