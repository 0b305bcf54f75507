"""Evidence-grounded document analytics on Spark DataFrames."""
