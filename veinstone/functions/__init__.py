"""Scalar expressions: columns in, a column out."""
