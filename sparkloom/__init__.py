"""A PySpark-native engine for scoring, comparing and reshaping collections of text units."""
