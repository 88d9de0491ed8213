"""Veilspark: find and redact personal data in text columns with Spark DataFrames."""

__version__ = "0.1.0"
