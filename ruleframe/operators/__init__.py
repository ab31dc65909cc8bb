"""Operators over files, incidents, dependencies and symbols, as DataFrame transformations."""
