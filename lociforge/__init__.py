"""Case/control analytics on Spark DataFrames."""
