"""Operators for preparing text corpora on Spark."""
