"""lexiweave: article categorization and corpus data processing on PySpark."""

__version__ = "0.1.0"
