"""Listening-history analytics, record resolution and list edits as Spark jobs."""
