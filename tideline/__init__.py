"""A PySpark-native engine for market time series."""
