"""Spark-first analytics engine for conversational retrieval and corpus curation."""

__version__ = "0.1.0"
