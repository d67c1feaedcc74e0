"""Structured Streaming runners and the operators that need their own streaming form."""
