"""Operators for building training data from text, embeddings and web pages.

Nothing else in the library imports this subpackage.
"""
