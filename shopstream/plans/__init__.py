"""Composite plans (dashboard) and the query registry used by the entry point."""
