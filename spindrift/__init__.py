"""Spindrift: declarative extraction and analytics over page tables, compiled to Spark DataFrame plans."""

__version__ = "0.1.0"
