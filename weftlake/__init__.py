"""Web and document corpus analytics expressed as Spark DataFrame transforms."""
