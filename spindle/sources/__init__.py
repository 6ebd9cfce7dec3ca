"""Spindle sources."""
