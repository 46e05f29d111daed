"""A PySpark-native engine for behaviour logs and ranked retrieval."""

__version__ = "0.1.0"
