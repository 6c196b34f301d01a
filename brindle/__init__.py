"""Spark-native document retrieval, audit analytics and corpus preparation."""
