"""Spark analytics over an append-only log of marketplace listing observations."""

__version__ = "0.1.0"
