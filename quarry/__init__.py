"""Support-desk and knowledge-base analytics as Spark DataFrame jobs."""
