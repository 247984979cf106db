"""Role mining over access rights, as Spark jobs."""
