"""Readers, writers and configuration files."""
