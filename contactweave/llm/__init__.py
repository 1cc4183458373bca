"""Operators for preparing training text: one module for each, queries in ``catalog``."""
