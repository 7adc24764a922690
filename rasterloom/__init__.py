"""Rasterloom: data work over large image collections as Spark plans."""

__version__ = "0.1.0"
