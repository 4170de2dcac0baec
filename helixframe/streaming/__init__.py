"""Incremental forms of the mergeable aggregates (an extension)."""
