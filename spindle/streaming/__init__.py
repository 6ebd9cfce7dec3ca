"""Spindle streaming."""
