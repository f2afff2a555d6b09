"""Readers of JSON, YAML and Markdown records, and their Arrow driver."""
