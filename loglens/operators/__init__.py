"""Operators over frames of lines."""
