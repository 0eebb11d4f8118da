"""Analytics over ticks, annotated sequences and text, as plain functions from DataFrames to DataFrames."""
