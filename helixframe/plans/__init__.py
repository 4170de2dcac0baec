"""Composite programs over the operators."""
