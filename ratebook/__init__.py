"""Tariff rating, corpus, retrieval and quality jobs as PySpark DataFrame operations."""
