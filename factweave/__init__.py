"""factweave: program-fact analytics and corpus preparation on PySpark DataFrames."""
