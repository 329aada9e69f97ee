"""tesserae: hybrid retrieval and bitemporal fact analytics on Spark DataFrames."""
