"""Code-and-SQL lineage analytics expressed as Spark DataFrames."""
