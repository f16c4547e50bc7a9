"""rillspark: place-and-time feature engineering and regression jobs on Spark DataFrames."""
