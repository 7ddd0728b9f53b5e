"""Detection, resolution, replacement, identity and evaluation."""
