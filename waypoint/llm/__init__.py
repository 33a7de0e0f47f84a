"""Operators on text corpora. Nothing outside this folder imports it."""
