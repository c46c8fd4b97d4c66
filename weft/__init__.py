"""Graphs from tables, and corpus preparation, as Spark plans."""
