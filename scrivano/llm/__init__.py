"""Training-data operators: near-duplicate joins, cleaning, mixing, sharding, scoring and output."""
