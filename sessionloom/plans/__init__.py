"""Operators put together: the whole recommender, and the queries with their SQL."""
