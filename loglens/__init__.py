"""loglens: search and analysis of very large line-oriented logs on Spark."""
