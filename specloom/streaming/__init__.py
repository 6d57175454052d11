"""streaming of specloom."""
