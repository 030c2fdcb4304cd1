"""Scalar functions on Spark columns."""
