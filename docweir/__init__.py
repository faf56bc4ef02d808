"""Document-to-Markdown analytics on Spark."""
