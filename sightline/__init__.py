"""Analytics over recorded and live observations, written for Spark."""
