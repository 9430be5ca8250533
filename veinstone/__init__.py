"""Veinstone: a document-analytics engine whose operators are Spark plans."""
