"""veriledger: evidence-grounded document analytics expressed on Spark DataFrames."""
