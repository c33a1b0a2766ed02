"""Operators for large-scale preparation of training data. Nothing else in the library imports this package."""
