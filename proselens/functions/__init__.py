"""proselens functions."""
