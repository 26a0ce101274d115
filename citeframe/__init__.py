"""Set-at-a-time grounded retrieval on Spark DataFrames."""
