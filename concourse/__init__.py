"""Concourse: built-space directory, geometry and route analytics as Spark DataFrame jobs."""

__version__ = "0.1.0"
