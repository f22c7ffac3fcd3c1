"""Compositions of operators: models, runs, staged jobs."""
