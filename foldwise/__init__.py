"""Double machine learning for time series, written for Spark DataFrames."""
