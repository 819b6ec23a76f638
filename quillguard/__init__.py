"""Spark-native detection, redaction and evaluation of sensitive values in text."""
