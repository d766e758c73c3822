"""The retained-cell histogram as a stream."""
