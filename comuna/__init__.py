"""City-service analytics as functions from DataFrames to a DataFrame."""
