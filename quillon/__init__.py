"""Spark-native analytics over scored claim records."""
