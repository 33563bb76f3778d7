"""Reports over columns."""
