"""quantloom: market analytics and corpus preparation on PySpark DataFrames."""
