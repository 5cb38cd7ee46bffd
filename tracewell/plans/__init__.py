"""Bound tables and the query catalogue."""
