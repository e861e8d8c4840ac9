"""Feature engineering over long event tables, on Spark DataFrames."""
