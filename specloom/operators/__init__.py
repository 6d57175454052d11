"""operators of specloom."""
