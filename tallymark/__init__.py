"""Versioned statistical releases as Spark DataFrames: ingest, type, check, measure, rank."""

__version__ = "0.1.0"
