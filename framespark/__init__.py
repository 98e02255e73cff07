"""Spark operators for the data side of detector-image machine learning."""
