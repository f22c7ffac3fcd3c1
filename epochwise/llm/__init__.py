"""Operators and pipeline for large text corpora."""
