"""Document analytics, retrieval evaluation and corpus preparation on Spark DataFrames."""
