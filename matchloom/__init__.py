"""Matching two large tables and ranking the matches, as Spark jobs."""
