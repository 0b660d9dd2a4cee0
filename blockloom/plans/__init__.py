"""plans of block change-log analytics."""
