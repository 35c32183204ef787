"""tidewise: a PySpark-native engine for panels of time series."""

__version__ = "0.1.0"
