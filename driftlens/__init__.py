"""Log comparison on Spark."""
