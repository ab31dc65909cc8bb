"""ruleframe: rule-driven analysis of files, documents and dependency graphs on Spark."""
