"""Operators over parsed records."""
