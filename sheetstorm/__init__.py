"""Monte Carlo spreadsheet models as Spark DataFrames."""
