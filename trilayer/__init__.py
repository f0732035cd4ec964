"""A graph-memory retrieval engine whose operators take and return DataFrames."""
