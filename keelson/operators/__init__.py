"""Dataset diff and joins."""
