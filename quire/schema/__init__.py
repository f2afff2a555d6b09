"""Logical types, schema validation and keyed lists."""
