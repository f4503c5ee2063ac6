"""booktide: a Spark-first engine for point-in-time evaluation of two-sided market data."""

__version__ = "0.1.0"
