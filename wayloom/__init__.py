"""Wayloom: road-network survey analytics as Spark DataFrame jobs."""
