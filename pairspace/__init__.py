"""pairspace: relations between word pairs, mined with Spark DataFrames."""
