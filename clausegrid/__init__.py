"""clausegrid: document-clause analytics on Spark DataFrames."""
