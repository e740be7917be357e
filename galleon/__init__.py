"""Galleon: image retrieval and corpus preparation as plain Spark jobs."""
