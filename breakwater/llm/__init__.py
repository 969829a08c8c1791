"""Operators of a training-data pipeline, their queries and checking SQL.  Nothing else in the library imports this."""
