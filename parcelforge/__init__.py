"""Spark-first analytics for land-deed text, parcel references and training-data hygiene."""

__version__ = "0.1.0"
