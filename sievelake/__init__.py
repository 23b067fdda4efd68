"""sievelake: a PySpark-native content-scanning and corpus-analytics engine."""

__version__ = "0.1.0"
