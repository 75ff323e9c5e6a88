"""Spark jobs over municipal traffic decrees: extraction, location, sync and list queries, keyed by commune."""
