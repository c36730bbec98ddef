"""Readers, extraction from pages, and sinks."""
