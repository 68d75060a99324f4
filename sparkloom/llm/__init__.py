"""Operators that a training-data pipeline needs; nothing else in the library imports this."""
