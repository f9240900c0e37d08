"""proselens operators."""
