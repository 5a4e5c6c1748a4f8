"""namewright: author-name disambiguation and corpus analytics on PySpark DataFrames."""
