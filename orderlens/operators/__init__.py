"""Jobs from DataFrames to DataFrames."""
