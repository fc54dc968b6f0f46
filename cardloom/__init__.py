"""Cardloom: search and analytics over a corpus of short HTML notes, on Spark DataFrames."""
