"""Message-archive search, ingest and statistics on Spark DataFrames."""
