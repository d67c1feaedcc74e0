"""Operators over event tables and streams."""
