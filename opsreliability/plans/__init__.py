"""Composed jobs and the views over the given tables."""
