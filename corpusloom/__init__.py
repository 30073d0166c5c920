"""Spark-native document conversion, chunking, retrieval and corpus preparation."""
