"""A PySpark-native engine for text retrieval analytics and training data."""
