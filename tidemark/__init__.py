"""Spark-native measurement analytics: operators, sources, functions, plans and streaming."""
