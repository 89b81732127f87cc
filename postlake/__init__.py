"""Social-post analytics expressed as Spark DataFrame, SQL and streaming jobs."""

__version__ = "0.1.0"
