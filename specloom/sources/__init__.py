"""sources of specloom."""
