"""Spark-native analytics over measurement cohorts held as long cell tables."""
