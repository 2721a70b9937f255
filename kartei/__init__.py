"""Folder audit on Spark: how well collections of files are organised, as DataFrame plans."""

__version__ = "0.1.0"
