"""Analytics over ordered captures of page text, on Spark DataFrames."""
