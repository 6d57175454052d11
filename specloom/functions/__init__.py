"""functions of specloom."""
