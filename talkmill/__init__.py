"""Spark-native analytics over large archives of JSON-lines discussion records."""
