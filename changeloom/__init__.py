"""Code-change analysis and training-data preparation as Spark DataFrame jobs."""
