"""Contract-document structuring and clause analytics as Spark DataFrame jobs."""
