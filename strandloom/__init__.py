"""Spark-first sequence annotation analytics."""
