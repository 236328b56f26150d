"""lexloom: keyword extraction, sparse retrieval and document analytics as Spark DataFrame jobs."""
