"""riskloom: supply-network graph analytics as composable Spark DataFrames."""
