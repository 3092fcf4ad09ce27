"""strata: versioned key-value data on Spark.

Changes are appended to a log, folded last-writer-wins by (ts, seq), stored as
immutable key-sorted bucketed Parquet runs under an atomically committed
manifest, and read by merging the runs bucket by bucket.
"""

__version__ = "0.1.0"
