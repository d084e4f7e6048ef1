"""docloom: document analytics expressed as Spark DataFrames, SQL and Arrow functions."""
