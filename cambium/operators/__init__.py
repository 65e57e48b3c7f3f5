"""Operators as functions from DataFrame to DataFrame."""
