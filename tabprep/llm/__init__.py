"""Operators for preparing text corpora: scoring, filtering, de-duplication and encoding of documents.

Nothing else in the library imports this subpackage.
"""
