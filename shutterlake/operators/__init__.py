"""Operators over canonical tables, as DataFrame functions."""
