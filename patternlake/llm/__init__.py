"""Operators for building training corpora: deduplication, filtering, archives and token files.

Nothing else in the library imports this package.
"""
