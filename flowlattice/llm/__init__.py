"""Operators of a training-data pipeline: documents, pages and conversations."""
