"""Jobs and the query catalogue."""
