"""Column functions: patterns, paths, versions, labels, templates."""
