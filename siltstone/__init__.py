"""A PySpark-native engine for selective queries over versioned tables, their indexes and their analysis."""
