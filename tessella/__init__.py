"""A feature-engineering engine on Spark DataFrames."""
