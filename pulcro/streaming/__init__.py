"""Rules applied to files as they arrive."""
