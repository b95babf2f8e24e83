"""lociflow: ancestry analytics along genomes, expressed as Spark DataFrame jobs."""
