"""Operators for preparing training data, each a DataFrame transformation."""
