"""Operators for pipelines that prepare training text: tokenizers, filters, deduplication, mixing, search and media.

Nothing else in the library imports this subpackage.
"""
