"""Spark-first operators for language-model training and evaluation data."""
