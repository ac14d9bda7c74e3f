"""Spark-native analytics for menu-scale food data."""
