"""Spark-native analytics for page-based media containers and the tables around them."""
