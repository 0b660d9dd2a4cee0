"""operators of block change-log analytics."""
