"""Point-of-sale audit report analytics, written as Spark DataFrame jobs."""
