"""Document-translation analytics expressed as Spark DataFrames."""
