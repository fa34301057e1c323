"""Scans, sinks and derived fixture tables."""
