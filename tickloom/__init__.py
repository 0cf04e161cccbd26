"""tickloom: a PySpark-native engine for per-service network telemetry."""

__version__ = "0.1.0"
