"""A PySpark-native engine for historical imagery catalogues."""
