"""Skein: document search and grounded question answering as Spark dataflow."""

__version__ = "0.1.0"
