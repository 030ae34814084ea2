"""Readers, writers, schemas and the views that present the test tables as market data."""
