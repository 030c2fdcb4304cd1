"""Keyed, time-windowed sets over event streams, on PySpark."""
