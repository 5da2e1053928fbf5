"""Retrieval, ranking, answer and evaluation operators, each from DataFrame to DataFrame."""
