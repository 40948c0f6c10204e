"""Routing data as Spark jobs."""
