"""Scalar functions: record codec, checksums, Bloom filter."""
