"""Drivers of multi-step analyses, and the query catalogue."""
