"""Supervised-learning analytics on tables and compositions, as PySpark plans."""
