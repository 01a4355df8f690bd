"""Spark-native analytics over ordered, versioned key-value data."""
