"""Ranked retrieval over versioned document collections, as Spark DataFrame plans."""
