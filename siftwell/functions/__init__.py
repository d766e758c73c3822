"""Column expressions: distribution tails, quantiles, snapping, adjustment of p-values."""
