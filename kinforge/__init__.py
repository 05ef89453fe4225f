"""Quantitative-genetics analytics on PySpark."""
