"""Tessera: image, vector, timeline and ledger analytics on Spark DataFrames."""
