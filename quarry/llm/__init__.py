"""Operators of a training-data pipeline over the corpus tables.

Nothing else in the library imports this package. Each module holds one
operator with a general interface; ``queries`` registers one query per
operator and ``sql`` holds the oracles that SQL can express."""
