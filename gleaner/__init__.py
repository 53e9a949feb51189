"""gleaner: a PySpark-native engine for content-digest analytics."""

__version__ = "0.1.0"
