"""Spark-native retrieval, chunking and corpus-preparation operators."""
