"""plans of specloom."""
