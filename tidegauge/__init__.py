"""Time-series anomaly work and its label loop as plain Spark DataFrame functions."""
