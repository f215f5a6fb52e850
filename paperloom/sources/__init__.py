"""Readers, databases and service connectors."""
