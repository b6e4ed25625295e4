"""Archive analytics for semi-structured API responses, expressed as Spark DataFrame operations."""
