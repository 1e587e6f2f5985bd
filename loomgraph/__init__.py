"""Estate graph analytics on Spark: facts about source repositories resolved into a graph and queried with DataFrames."""
