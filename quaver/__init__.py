"""Quaver: a Spark-native engine for searching and exploring embedded catalogs."""
