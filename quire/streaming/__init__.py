"""Incremental parsing and checking, as batches and as structured streams."""
