"""windlass.operators."""
