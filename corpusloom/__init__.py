"""Retrieval and document analytics as Spark DataFrame plans."""
