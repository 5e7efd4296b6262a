"""Analytics over versioned, ordered key-value logs, as Spark DataFrame operations."""
