"""Operators for training-data pipelines. Queries and their SQL are in ``queries``."""
