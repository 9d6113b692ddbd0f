"""A Spark-native engine for web observations."""
