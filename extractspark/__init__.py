"""Spark-native web-data extraction and text analytics."""
