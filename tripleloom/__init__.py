"""Knowledge-graph operators over Spark DataFrames."""
