"""Link-graph analytics on Spark DataFrames."""
