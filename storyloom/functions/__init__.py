"""Part of storyloom."""
