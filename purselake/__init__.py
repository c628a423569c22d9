"""purselake: public-spending analytics expressed as Spark DataFrames."""
