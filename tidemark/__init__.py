"""Event-sequence analytics as Spark DataFrame jobs."""
