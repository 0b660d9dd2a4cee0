"""sources of block change-log analytics."""
