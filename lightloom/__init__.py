"""Lightloom: irregular time series and feature-vector analytics as PySpark plans."""
