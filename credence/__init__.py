"""Spark-native analytics of probabilistic decisions and logged feedback."""
