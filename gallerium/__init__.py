"""gallerium: a Spark-first engine for federated image-metadata search and ranking."""
