"""Operators for training data: vectors, clusters, packing, mixing, languages. Nothing outside imports this folder."""
