"""Scans, sinks and shared intermediate tables."""
