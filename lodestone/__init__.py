"""Lodestone: retrieval, filing analytics and evaluation as lazy PySpark plans."""
