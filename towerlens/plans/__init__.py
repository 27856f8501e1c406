"""Whole queries: inputs, batch jobs, serving questions, and the catalogue."""
