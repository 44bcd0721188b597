"""Spark-first analytics: relational, time-series, graph, text and history operators."""
