"""Find, score, suppress, resolve and redact sensitive text with Spark."""
