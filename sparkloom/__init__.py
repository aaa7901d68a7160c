"""PySpark-native engine for building and auditing web-text corpora."""
