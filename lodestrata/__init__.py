"""lodestrata: corpus indexing, retrieval and analytics as Spark DataFrame operators."""
