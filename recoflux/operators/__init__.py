"""Relational operators of the recommender."""
