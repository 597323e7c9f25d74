"""Operators for large training corpora. Nothing else in riskloom imports this package."""
