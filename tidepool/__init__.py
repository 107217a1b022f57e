"""Spark-native analytics over photo-archive style tables."""
