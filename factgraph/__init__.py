"""factgraph: code-base facts and corpus operators as PySpark DataFrames."""
