"""Lodestone: search, similarity, graph and training-data analytics as PySpark jobs."""
