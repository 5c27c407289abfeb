"""tally: exact and sketched counting, change data, audits and table lifecycle on Spark DataFrames."""
