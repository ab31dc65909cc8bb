"""Readers of files, lines, dependencies, symbols and rules."""
