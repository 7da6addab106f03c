"""Readers, writers and parsers that turn files into graph rows."""
