"""kinforge: record linkage and family-tree analytics as Spark DataFrame jobs."""
