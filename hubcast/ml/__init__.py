"""Spark ML stages and pipelines."""
