"""framelens: record-frame analytics on Spark DataFrames."""
