"""tidemark: event-time completeness analytics on Spark DataFrames."""
