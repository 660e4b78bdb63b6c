"""Operators and queries of the training-data pipeline. Nothing outside this folder imports it."""
