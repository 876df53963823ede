"""Combat-log analytics as Spark DataFrame jobs."""
