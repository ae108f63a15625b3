"""doclens: document-understanding and training-data operators on PySpark DataFrames."""
