"""The same statistics over files as they arrive."""
