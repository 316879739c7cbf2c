"""quarry: retrieval and corpus analytics written for Spark."""
