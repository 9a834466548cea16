"""A Spark-first engine for timestamped multi-stream tables."""

__version__ = "0.1.0"
