"""Corpus-health operators."""
