"""spanveil: sensitive-span analytics on Spark DataFrames."""
