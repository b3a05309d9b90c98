"""eventide: event-marketplace analytics as Spark DataFrame, SQL and streaming jobs."""
