"""Following files that grow."""
