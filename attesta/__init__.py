"""attesta: evidence-backed entity data as Spark DataFrames."""
