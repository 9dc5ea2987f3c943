"""PySpark-native analytics for two-sided review text."""

__version__ = "0.1.0"
