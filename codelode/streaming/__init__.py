"""Continuous forms of the jobs."""
