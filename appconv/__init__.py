"""App conversion analytics as plain Spark DataFrame and Spark ML jobs."""
