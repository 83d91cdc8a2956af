"""Spark jobs that turn many source repositories into a searchable chunk index."""
