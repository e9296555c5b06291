"""Corpus-health streaming."""
