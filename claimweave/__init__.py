"""Positional claims files and synthetic tables as Spark jobs."""
