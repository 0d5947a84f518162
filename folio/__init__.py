"""A PySpark-native engine for long-form text corpora."""
