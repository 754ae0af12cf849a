"""Spark-native document curation and hybrid retrieval."""
