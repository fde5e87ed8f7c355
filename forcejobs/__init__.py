"""Spark jobs for vertical ground-reaction-force recordings."""
