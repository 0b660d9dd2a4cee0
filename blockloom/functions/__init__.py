"""functions of block change-log analytics."""
