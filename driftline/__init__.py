"""Table replication as DataFrame and Structured Streaming operators."""
