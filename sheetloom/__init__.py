"""Drawing and plant-configuration analytics on Spark DataFrames."""
