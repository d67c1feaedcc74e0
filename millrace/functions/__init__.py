"""Expressions, aggregates and user-defined functions."""
