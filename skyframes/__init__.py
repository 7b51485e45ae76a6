"""skyframes: reduction and analysis of ordered frame stacks on Spark DataFrames."""
