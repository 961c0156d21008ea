"""PySpark-native analytics for evidence corpora and coded tables."""
