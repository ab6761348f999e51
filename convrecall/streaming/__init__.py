"""Streaming forms of the memory operators."""
