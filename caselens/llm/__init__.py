"""Operators of a training-data pipeline over documents, and the queries that apply them."""
