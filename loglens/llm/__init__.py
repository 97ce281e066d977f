"""Operators for large training-data pipelines; nothing else in loglens imports this subpackage."""
