"""Operational reliability analytics expressed as Spark DataFrame jobs."""
