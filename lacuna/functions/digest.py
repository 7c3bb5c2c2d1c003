"""Order-free digests of whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def row_hash(*cols: Column) -> Column:
    """SHA-256 of one row; nulls and separators are written so that fields cannot run together."""
    parts = [F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-")) for c in cols]
    return F.sha2(F.concat_ws("|", *parts), 256)


def multiset_digest(df: DataFrame, hash_col: str = "row_hash") -> DataFrame:
    """One row: row count and a digest of the bag of row hashes.

    Four 60-bit lanes of every hash are added up. Sums commute, so the digest needs no
    sort and no collected list: each task adds its own rows and only four numbers
    per task are shuffled, whatever the table size.
    """
    return group_digest(df, hash_col=hash_col)


def group_digest(df: DataFrame, *keys: str, hash_col: str = "row_hash") -> DataFrame:
    """The digest of :func:`multiset_digest` for each group of ``keys``."""
    h = F.col(hash_col)
    lanes = [F.sum(F.conv(F.substring(h, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")) for i in range(4)]
    summed = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count"),
                    *[F.coalesce(s, F.lit(0).cast("decimal(38,0)")).alias(f"lane_{i}") for i, s in enumerate(lanes)])
    return summed.select(
        *keys, "row_count",
        F.sha2(F.concat_ws(":", F.col("row_count").cast("string"),
                           *[F.col(f"lane_{i}").cast("string") for i in range(4)]), 256).alias("digest"))
