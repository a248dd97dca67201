"""Operators for preparing large text corpora: scoring, search, deduplication, tokens, packing, secrets.

Nothing else in the library imports this subpackage.
"""
