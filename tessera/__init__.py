"""Episode analytics on Spark."""
