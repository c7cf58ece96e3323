"""windlass.functions."""
