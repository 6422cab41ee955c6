"""Operators for building training and retrieval data from text, vectors and scores.

Nothing outside this subpackage imports it.
"""
