"""corpusloom: document-retrieval analytics as Spark DataFrame operators."""
