"""siftwell: adaptive cell quality control and corpus preparation on Spark."""

__version__ = "0.1.0"
