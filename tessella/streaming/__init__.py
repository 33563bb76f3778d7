"""Records that keep arriving."""
