"""Operators for large training corpora, and their queries."""
