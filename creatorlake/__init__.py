"""creatorlake: creator and content-performance analytics, written for Spark DataFrames."""
