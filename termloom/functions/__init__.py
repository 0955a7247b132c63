"""Scalar functions on columns: text, vectors, JSON repair."""
