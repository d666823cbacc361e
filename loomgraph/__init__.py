"""A PySpark-native engine that turns collections of documents into a property graph."""
