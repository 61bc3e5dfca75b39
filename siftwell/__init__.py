"""A Spark-native engine for full-text and metadata search over documents, properties and triples."""
