"""fragloom: evidence-fragment analytics as Spark DataFrame jobs."""
