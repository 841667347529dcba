"""A PySpark-native engine for structuring, indexing and querying large collections of documents."""
