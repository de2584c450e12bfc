"""Sequence analytics and corpus preparation as plain Spark jobs."""

__version__ = "0.1.0"
