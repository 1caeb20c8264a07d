"""tidemark: demand and weather feature marts, online features and quality checks as Spark jobs."""
