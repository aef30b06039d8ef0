"""scholia: a PySpark-native engine for bibliographic and document metadata."""

__version__ = "0.1.0"
