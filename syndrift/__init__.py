"""A PySpark-native engine for quantum-error-correction syndrome streams."""

__version__ = "0.1.0"
