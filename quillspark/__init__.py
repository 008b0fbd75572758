"""Document-lint analytics and corpus operators as Spark jobs."""
