"""Topic-map analytics expressed as Spark DataFrame jobs."""
