"""Retrieval, text analytics and training-data operators on PySpark."""
