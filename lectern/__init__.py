"""Document narration analytics on Spark: import, normalise, plan, time and check spoken text as DataFrames."""
