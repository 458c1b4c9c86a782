"""Graph-learning analytics on PySpark DataFrames."""
