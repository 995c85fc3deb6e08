"""Spark-native analytics over catalogues of software artifacts and their change over time."""
