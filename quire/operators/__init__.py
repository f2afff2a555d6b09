"""Relational operators over the canonical tables: files, records, nodes, anchors, tags, refs, aliases and issues."""
