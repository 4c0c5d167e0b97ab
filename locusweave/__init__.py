"""locusweave: interval analytics over sample-by-position call sets, on PySpark DataFrames."""
