"""Review analytics as Spark DataFrame jobs, for all businesses at once."""
