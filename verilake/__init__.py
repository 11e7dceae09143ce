"""verilake: audit verified rewrites of very large file collections with Spark."""
