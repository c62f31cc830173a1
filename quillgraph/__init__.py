"""Document-graph retrieval as Spark DataFrame jobs."""
