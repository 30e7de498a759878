"""vellumine: a Spark-native engine for scholarly document data."""
