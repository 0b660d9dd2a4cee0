"""streaming of block change-log analytics."""
