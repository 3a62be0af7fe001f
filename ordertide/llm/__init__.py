"""Operators for preparing training text: each module holds one operator and the query that applies it."""
