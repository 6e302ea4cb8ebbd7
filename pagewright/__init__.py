"""pagewright: document-processing and document-quality operators for Spark DataFrames."""
