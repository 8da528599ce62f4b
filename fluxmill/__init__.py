"""fluxmill: flow-record analytics on Spark DataFrames."""
