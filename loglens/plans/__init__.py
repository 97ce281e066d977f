"""The query language, the search box and filter sets, compiled to columns on the driver."""
