"""Document and drawing analytics as Spark jobs."""
