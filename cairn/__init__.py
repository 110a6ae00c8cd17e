"""A catalog and corpus engine on Spark: archive members as tables, queried with DataFrames."""
