"""Evidence-graph analytics on PySpark DataFrames."""
