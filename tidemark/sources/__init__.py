"""Readers, report parsers and sinks."""
