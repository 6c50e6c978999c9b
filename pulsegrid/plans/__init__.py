"""Composite queries over the domain tables."""
