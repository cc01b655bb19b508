"""Set-oriented analytics over hotel, traffic, news and document tables, on Spark DataFrames."""
