"""Named queries over the canonical tables."""
