"""A PySpark engine that summarises logs, blocks and semi-structured records."""

__version__ = "0.1.0"
