"""Operators of a training-data pipeline: one module each, none imported by the rest of the library."""
