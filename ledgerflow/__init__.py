"""Message tables to ledgers on Spark DataFrames."""
