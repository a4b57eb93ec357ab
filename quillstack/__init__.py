"""Document analytics as Spark jobs: preparation, models, search and language operators."""
