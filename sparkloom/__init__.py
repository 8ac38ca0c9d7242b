"""Spark-native analytics over operational audit data, document corpora and retrieval results."""
