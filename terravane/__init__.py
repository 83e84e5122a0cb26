"""Spark-native analytics for surveyed terrain, flight logs and their data preparation."""
