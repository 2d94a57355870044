"""dyadflow: paired categorical sequences, and relational glue, on Spark DataFrames."""
