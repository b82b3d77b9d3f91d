"""Fail-closed corpus sanitisation on Spark: detect, rewrite, re-verify, keep evidence."""

__version__ = "0.1.0"
