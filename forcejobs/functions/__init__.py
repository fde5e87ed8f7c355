"""Force-trace jobs."""
