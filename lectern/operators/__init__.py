"""Operators over documents: DataFrame → DataFrame."""
