"""A PySpark-native engine for document retrieval, answer analytics and training-data preparation."""
