"""isoweave: splicing analytics and corpus preparation on Spark DataFrames."""
