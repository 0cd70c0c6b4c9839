"""Site and city geodata engine on Spark DataFrames."""
