"""rivulet: flow analytics on PySpark DataFrames."""
