"""docloom: document preparation, retrieval and evaluation as Spark jobs."""
