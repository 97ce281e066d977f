"""Column expressions: records, text, regular expressions, time values."""
