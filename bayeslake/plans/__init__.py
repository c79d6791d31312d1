"""DAG metadata and the registered query catalogue."""
