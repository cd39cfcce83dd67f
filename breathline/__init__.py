"""Breathline: vital-sign time-series analytics over many sessions on Spark."""
