"""tallyreef: explainable recommendation analytics on Spark DataFrames."""
