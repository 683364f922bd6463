"""Operators over tables of page items, lines, objects, pixels and edits."""
