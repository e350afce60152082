"""Evidence analytics over text, findings and event logs, on Spark DataFrames."""
