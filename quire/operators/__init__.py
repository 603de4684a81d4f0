"""Operators over the canonical tables (chapters, lines, volumes, index tables)."""
