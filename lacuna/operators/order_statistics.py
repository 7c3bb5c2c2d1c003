"""Exact percentiles of groups of any size by radix selection.

A double's bit pattern, with the lower bits of negative numbers flipped, sorts like the number itself. Four digits of 16 bits are fixed
from the top: each round counts the next digit of the values that share the digits found so far, and running counts over at most 65,536 digits
tell which one holds the wanted rank. Counting is combined map side, so no group is gathered in a buffer or sorted in a task,
however large it is. The values are read once per digit from a checkpoint.

A percentile lies between its two neighbouring ranks in proportion, as in ``percentile`` and ``median``; NaN counts as the largest number, and
both zeros are one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lacuna.session import checkpoint_dir

DIGITS, BITS = 4, 16
_LOW = np.int64(np.iinfo(np.int64).max)


def to_bits(x: np.ndarray) -> np.ndarray:
    """Longs that sort like the doubles."""
    x = np.where(np.isnan(x), np.nan, x + 0.0)
    bits = x.view(np.int64)
    return bits ^ (bits >> 63 & _LOW)


def from_bits(bits: np.ndarray) -> np.ndarray:
    return (bits ^ (bits >> 63 & _LOW)).view(np.float64)


@F.pandas_udf(T.LongType())
def _to_bits(v: pd.Series) -> pd.Series:
    return pd.Series(to_bits(v.to_numpy(np.float64)))


@F.pandas_udf(T.DoubleType())
def _from_bits(v: pd.Series) -> pd.Series:
    return pd.Series(from_bits(v.to_numpy(np.int64)))


def _same(a: list[str], b: list[str]) -> Column:
    on = F.lit(True)
    for x, y in zip(a, b, strict=True):
        on &= F.col(x).eqNullSafe(F.col(y))
    return on


def percentiles(values: DataFrame, group: list[str], value: str, fractions: dict[str, float]) -> DataFrame:
    """Per group: its columns and one column per name in ``fractions``. Null values are left out; groups without others don't occur."""
    checkpoint_dir(values.sparkSession)
    keys = [f"__g{k}" for k in range(len(group))]
    rows = values.where(F.col(value).isNotNull()).select(*[F.col(g).alias(k) for g, k in zip(group, keys, strict=True)], _to_bits(F.col(value).cast("double")).alias("__bits")).checkpoint()
    names = list(fractions)
    at = [F.struct(F.lit(k).alias("which"), (F.lit(fractions[name]) * (F.col("__n") - 1)).alias("position")) for k, name in enumerate(names)]
    ranks = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).select(*keys, F.explode(F.array(*at)).alias("w"))
    position = F.col("w.position")
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.floor(position).alias("rank")), F.struct(F.lit(1).alias("side"), F.ceil(position).alias("rank"))))
    wanted = ranks.select(*keys, F.col("w.which").alias("which"), position.alias("position"), sides.alias("s")).select(*keys, "which", "position", "s.side", F.col("s.rank").alias("rank"), F.lit(0).cast("long").alias("prefix"))
    for digit in range(DIGITS):
        shift = BITS * (DIGITS - 1 - digit)
        top = F.shiftright("__bits", shift)  # the first digit is signed and sorts so
        prefix = F.shiftright("__bits", shift + BITS) if digit else F.lit(0).cast("long")
        counted = rows.select(*keys, top.alias("top"), prefix.alias("prefix"))
        if digit:  # values that share the digits of some wanted rank
            sought = wanted.select(*[F.col(k).alias(f"{k}w") for k in keys], F.col("prefix").alias("prefixw")).distinct()
            counted = counted.join(sought, _same([*keys, "prefix"], [*[f"{k}w" for k in keys], "prefixw"]), "left_semi")
        counted = counted.groupBy(*keys, "prefix", "top").agg(F.count(F.lit(1)).alias("n"))
        order = Window.partitionBy(*keys, "prefix").orderBy("top")
        counted = counted.withColumn("before", F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        counted = counted.select(*[F.col(k).alias(f"{k}c") for k in keys], F.col("prefix").alias("prefixc"), "top", "n", "before")
        found = wanted.join(counted, _same([*keys, "prefix"], [*[f"{k}c" for k in keys], "prefixc"])).where((F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("n")))
        wanted = found.select(*keys, "which", "position", "side", (F.col("rank") - F.col("before")).alias("rank"), F.col("top").alias("prefix")).checkpoint()
    number = F.when(F.col("prefix") == int(to_bits(np.array([np.nan]))[0]), F.lit(float("nan"))).otherwise(_from_bits("prefix"))  # pandas takes NaN for null
    ends = wanted.withColumn("v", number).groupBy(*keys, "which", "position").agg(F.max(F.when(F.col("side") == 0, F.col("v"))).alias("low"), F.max(F.when(F.col("side") == 1, F.col("v"))).alias("high"))
    low, high, p = F.col("low"), F.col("high"), F.col("position")
    between = F.when(low == high, low).otherwise((F.ceil(p) - p) * low + (p - F.floor(p)) * high)
    out = ends.withColumn("v", between).groupBy(*keys).agg(*[F.max(F.when(F.col("which") == k, F.col("v"))).alias(name) for k, name in enumerate(names)])
    return out.select(*[F.col(k).alias(g) for k, g in zip(keys, group, strict=True)], *names)


def with_percentiles(grouped: DataFrame, values: DataFrame, group: list[str], value: str, fractions: dict[str, float]) -> DataFrame:
    """``grouped``, one row per group, and the percentiles of the groups' values."""
    found = percentiles(values, group, value, fractions)
    names = [f"__p{k}" for k in range(len(group))]
    found = found.select(*[F.col(g).alias(n) for g, n in zip(group, names, strict=True)], *fractions)
    return grouped.join(found, _same(group, names), "left").drop(*names)
