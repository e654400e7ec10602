"""Invoice-exception and document-evidence analytics as Spark DataFrame jobs."""
