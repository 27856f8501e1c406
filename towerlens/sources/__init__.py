"""Readers for files, tables and streams, and the text-line parsers."""
