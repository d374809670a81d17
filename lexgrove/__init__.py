"""lexgrove: corpus, retrieval and record search as Spark DataFrame jobs."""

__version__ = "0.1.0"
