"""Analytics over governed, bitemporal memory data, as plans over Spark DataFrames."""
