"""parleyworks: conversation and knowledge-graph analytics on PySpark DataFrames."""
