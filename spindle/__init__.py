"""Spindle: prompt-dataset preparation, auditing and scoring as PySpark DataFrame operators."""
