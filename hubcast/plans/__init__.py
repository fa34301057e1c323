"""Composed analyses built from the operators (flagship rollup, summaries, checks)."""
