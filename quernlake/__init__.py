"""Text, retrieval and graph analytics expressed as Spark DataFrame operations."""
