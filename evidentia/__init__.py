"""Evidence retrieval, grounding and text preparation as Spark jobs."""
