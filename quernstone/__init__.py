"""Spark-native engine that scores document collections against evidence catalogs."""
