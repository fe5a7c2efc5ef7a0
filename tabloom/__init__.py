"""A PySpark-native engine for annotating tables against a knowledge base."""
