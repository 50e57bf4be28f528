"""Operators for preparing model training data. Nothing else in the library imports this package."""
