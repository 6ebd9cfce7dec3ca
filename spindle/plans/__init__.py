"""Spindle plans."""
