"""PySpark-native text-index and string-analytics operators."""
