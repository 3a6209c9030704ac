"""auditlake: Spark-native analytics for operational record submissions."""

__version__ = "0.1.0"
