"""Sharding by jump consistent hashing.

A key and the number of shards decide the shard; no ring table is kept. With one
more shard, a key either stays or goes to the new one. The method is that of
"A Fast, Minimal Memory, Consistent Hash Algorithm" (2014): a pseudo-random walk of
the key jumps over shard counts, and the last count before ``shards`` is its shard.

Defined results: a null key is hashed like any value and has a shard; equal keys
share one; an empty table gives an empty one. Further columns may be of any type that can
be grouped by, and maps in any depth, which are compared as sorted lists of entries.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Rows that one window task numbers, about; the number of blocks follows the table.
BLOCK_ROWS = 200_000


def jump_numpy(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each unsigned 64-bit key."""
    if shards < 1:
        raise ValueError("there must be a shard")
    key = keys.astype(np.uint64).copy()
    found = np.zeros(len(key), np.int64)
    ahead = np.zeros(len(key), np.int64)
    todo = np.arange(len(key))
    while len(todo):
        found[todo] = ahead[todo]
        key[todo] = key[todo] * np.uint64(2862933555777941757) + np.uint64(1)
        top = (key[todo] >> np.uint64(33)).astype(np.float64) + 1.0
        ahead[todo] = ((found[todo] + 1) * (float(1 << 31) / top)).astype(np.int64)
        todo = todo[ahead[todo] < shards]
    return found.astype(np.int32)


def shard_of(key: Column, shards: int) -> Column:
    """Shard of a key of any type; keys are hashed first, so runs of numbers spread."""

    @F.pandas_udf("int")
    def pick(hashed: pd.Series) -> pd.Series:
        return pd.Series(jump_numpy(hashed.to_numpy(np.int64).view(np.uint64), shards))

    return pick(F.xxhash64(key))


def assign(df: DataFrame, key: str, shards: int, name: str = "shard") -> DataFrame:
    """Add the shard; rows do not move, other columns (but an old ``name``) stay."""
    return df.withColumn(name, shard_of(F.col(key), shards))


def _holds_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _holds_map(kind.elementType)
    if isinstance(kind, T.StructType):
        return any(_holds_map(f.dataType) for f in kind.fields)
    return isinstance(kind, T.MapType)


def _without_maps(c: Column, kind: T.DataType, back: bool = False) -> Column:
    """``c`` of type ``kind`` with every map as a sorted list of entries, or ``back`` from that."""
    if not _holds_map(kind):
        return c
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda e: _without_maps(e, kind.elementType, back))
    if isinstance(kind, T.StructType):
        parts = [_without_maps(c.getField(f.name), f.dataType, back).alias(f.name) for f in kind.fields]
        return F.when(c.isNotNull(), F.struct(*parts))

    def entry(e: Column) -> Column:
        return F.struct(
            e["key"].alias("key"), _without_maps(e["value"], kind.valueType, back).alias("value")
        )

    if back:
        return F.map_from_entries(F.transform(c, entry))
    return F.array_sort(F.transform(F.map_entries(c), entry))


def numbered(df: DataFrame, shard: str = "shard", slot: str = "slot") -> DataFrame:
    """Add each row's place in its shard: 0, 1, 2 … without gaps.

    Equal rows are folded to one with a count before any window, so that repeated
    rows never gather; a shard is cut into blocks by the hash of its rows, which are
    numbered apart, and blocks are offset by the sums of those before. The order is
    arbitrary but the same in every run over the same rows.
    """
    if slot in df.columns:
        df = df.drop(slot)
    given, columns = df.columns, [f"c{i}" for i in range(len(df.columns))]  # no name can clash
    kinds = [f.dataType for f in df.schema.fields]
    shard, last = f"c{given.index(shard)}", slot
    plain = df.toDF(*columns).select(*[_without_maps(F.col(c), k).alias(c) for c, k in zip(columns, kinds)])
    folded = plain.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n"))
    blocks = max(1, -(-df.count() // BLOCK_ROWS))
    cut = folded.withColumn("_block", F.pmod(F.xxhash64(*columns, F.lit("block")), F.lit(blocks)))
    sizes = cut.groupBy(shard, "_block").agg(F.sum("_n").alias("_size"))
    before = Window.partitionBy(shard).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(
        F.col(shard).alias("_shard"), F.col("_block").alias("_at"),
        F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"),
    )
    inside = (
        Window.partitionBy(shard, "_block").orderBy(*columns).rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        cut.withColumn("_first", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
        .join(sizes, F.col(shard).eqNullSafe(F.col("_shard")) & (F.col("_block") == F.col("_at")))
        .withColumn("_first", F.col("_first") + F.col("_before"))
        .select(*columns, F.explode(F.sequence("_first", F.col("_first") + F.col("_n") - 1)))
        .select(*[_without_maps(F.col(c), k, back=True).alias(c) for c, k in zip(columns, kinds)], "col")
        .toDF(*given, last)
    )
