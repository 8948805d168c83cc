"""A Spark engine that turns fetched search-result pages into clean, ranked tables."""
