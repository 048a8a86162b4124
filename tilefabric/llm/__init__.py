"""Training-data operators on DataFrames: dedup, mixing, packing, filtering, sharding, output."""
