"""Progressive runs."""
