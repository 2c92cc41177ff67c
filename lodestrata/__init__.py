"""Lodestrata: ordered, byte-keyed key-value analytics expressed as Spark plans."""

__version__ = "0.1.0"
