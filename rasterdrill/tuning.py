"""Session settings, size-checked broadcasts and the shared work folder."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

# A broadcast side is at most this many rows. A row is some 40 bytes, but takes several
# times that in the driver while it is collected and hashed, and a drill has many of them.
BROADCAST_ROWS = 100_000

# Rows of a small side that one partition may hold hashed, where tables meet tile by tile.
HASHED_ROWS = 1_000_000
# Partitions by tile, as a multiple of the shuffle partitions: pixels of one are held at once
# where they are merged or aligned.
TILE_PARTS = 4

SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.files.maxPartitionBytes": "128m",
    # Tables bucketed by tile and time align on time and pixel as they lie, and so do tables
    # dealt by tile, which set this themselves (see ``by_tile``).
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    # Recording the call site of every column expression takes milliseconds each.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def sized(df: DataFrame, rows: int) -> DataFrame:
    """Hint ``df`` for broadcast if ``rows`` bounds it within the limit, else for a merge.

    The merge hint matters: the planner's own estimate of an exploded table is
    the size of its input, so it may broadcast one that is far too large.
    """
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df.hint("merge")


def by_tile(df: DataFrame) -> DataFrame:
    """Rows dealt by ``tile_id``.

    The number of partitions is stated, so that tables dealt alike meet as they lie and
    adaptive execution does not merge partitions whose rows are still to multiply. Spark
    leaves the shuffle out where rows are dealt so already. That joins on the tile and more
    are satisfied by it is a setting, which is left on: plans are made after this returns.
    """
    spark = df.sparkSession
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return df.repartition(TILE_PARTS * int(spark.conf.get("spark.sql.shuffle.partitions")), "tile_id")


def dealt(pixels: DataFrame, *bounds: int) -> DataFrame:
    """Pixels by tile, if one of the tables they meet next is beyond the broadcast limit."""
    return by_tile(pixels) if max(bounds) > BROADCAST_ROWS else pixels


def beside(df: DataFrame, rows: int) -> DataFrame:
    """Hint ``df (tile_id, ...)`` for a join with pixels on the tile and more.

    Beyond the broadcast limit it is dealt by tile and hashed by partition, so that pixels
    that are :func:`dealt` are neither moved nor sorted for the join.
    """
    if rows <= BROADCAST_ROWS:
        return F.broadcast(df)
    parts = TILE_PARTS * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return by_tile(df).hint("shuffle_hash" if rows <= HASHED_ROWS * parts else "merge")


@contextmanager
def one_job(spark: SparkSession) -> Iterator[None]:
    """Run metadata queries as one job each.

    Adaptive execution submits every stage as a job and plans again after it, which takes
    longer than these queries over scenes and polygons do.
    """
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def one_row(df: DataFrame) -> Row:
    """The row of an aggregate, in one job."""
    with one_job(df.sparkSession):
        return df.collect()[0]


def counted(df: DataFrame) -> DataFrame:
    """:func:`sized` with the size counted; for metadata tables, never pixels."""
    return sized(df, rows_of(df))


def rows_of(df: DataFrame) -> int:
    """The number of rows of a metadata table, in one job."""
    return one_row(df.agg(F.count(F.lit(1))))[0]


def shared_folder(spark: SparkSession) -> str:
    """A folder all executors see: ``spark.checkpoint.dir``, else the warehouse folder."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir", None)
    if not named:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return named
