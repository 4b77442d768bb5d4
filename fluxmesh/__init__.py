"""Field analytics on Spark."""
