"""Operators that prepare text corpora for model training, and the queries that apply them."""
