"""Record linkage, deduplication and reporting on Spark DataFrames."""
