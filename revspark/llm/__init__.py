"""Operators for building training data from raw documents and web pages."""
