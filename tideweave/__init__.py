"""Event-time analytics with shared multi-query plans on Spark."""
