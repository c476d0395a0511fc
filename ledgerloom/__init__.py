"""Table-parametric audit, profiling, splitting and modelling operators on Spark DataFrames."""
