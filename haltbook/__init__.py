"""Spark-native downtime analytics: notices -> events -> incidents -> reports."""
