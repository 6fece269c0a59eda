"""A Spark-native engine for the data that code-analysis tools produce."""
