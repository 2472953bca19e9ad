"""Operators for text corpora and large numeric records. Nothing outside this folder imports it."""
