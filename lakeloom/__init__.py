"""lakeloom: a Spark-first engine for media and document archives."""
