"""Check modules, their registry and their reports."""
