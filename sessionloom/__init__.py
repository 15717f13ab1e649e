"""Session analytics and recommendation on PySpark DataFrames."""
