"""Reading logs and writing results."""
