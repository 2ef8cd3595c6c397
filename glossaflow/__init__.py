"""glossaflow: PySpark-native text annotation analytics."""

__version__ = "0.1.0"
