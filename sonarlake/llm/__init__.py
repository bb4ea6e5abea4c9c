"""Operators of a training-data pipeline: ten of them, their queries and their SQL."""
