"""proselens sources."""
