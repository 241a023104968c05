"""Spark jobs for narrative-text corpora."""
