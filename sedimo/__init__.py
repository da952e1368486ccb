"""A PySpark-native engine for versioned, last-write-wins keyed tables."""
