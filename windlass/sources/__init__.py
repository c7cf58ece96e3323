"""windlass.sources."""
