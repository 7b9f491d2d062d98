"""cairn: a Spark-native engine for code and document intelligence tables."""
