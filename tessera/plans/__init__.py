"""Named queries, the builder, validation and explain."""
