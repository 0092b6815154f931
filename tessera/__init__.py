"""Spark-native code intelligence, retrieval and corpus analytics."""
