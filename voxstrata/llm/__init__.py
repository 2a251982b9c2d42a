"""Operators for large training-text corpora.  Nothing outside imports this package."""
