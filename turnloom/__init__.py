"""turnloom: a PySpark-native analytics engine for coding-assistant session logs."""

__version__ = "0.1.0"
