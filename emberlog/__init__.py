"""Emberlog: log intelligence and corpus preparation as Spark jobs."""
