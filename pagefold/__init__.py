"""PySpark-native analytics for fields extracted from document pages."""
