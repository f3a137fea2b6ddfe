"""Ridgeline: curve-ensemble and uncertainty analytics as Spark jobs."""
