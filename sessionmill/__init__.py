"""Session-log analytics for coding agents, written as plain Spark jobs."""
