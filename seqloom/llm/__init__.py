"""Operators for training-data pipelines over tables of documents, vectors and pages."""
