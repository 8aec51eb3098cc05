"""Jobs that take up where the last one ended."""
