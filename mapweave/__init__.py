"""Map-data analytics as plain Spark DataFrame programs."""
