"""Verdigris: evaluation analytics for text benchmarks, as PySpark DataFrame operators."""
