"""termloom: terminology mapping, retrieval, hierarchy and evaluation operators on Spark DataFrames."""
