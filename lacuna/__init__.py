"""Lacuna: supervisory analytics for security operations, as Spark DataFrame jobs."""
