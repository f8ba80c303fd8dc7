"""Connected components of a table of links, by alternating stars.

Each round points every node's larger neighbours, then its smaller ones, to the
smallest node it knows ("Connected Components in MapReduce and Beyond", 2014). The
links between rounds are a written table. Minima are taken with map-side partials and
joined back by node; that join brings the links of a hub to one task, where adaptive
execution does not split it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterdrill.llm.store import Work


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One half round over links ``(a, b)`` with a < b."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if large:
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        out = both.filter("b > a").join(least, "a").select(F.col("m").alias("a"), "b")
    else:
        down = both.filter("b < a")
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        joined = down.join(least, "a")
        out = joined.select(F.col("m").alias("a"), "b").unionByName(least.select(F.col("m").alias("a"), F.col("a").alias("b")))
    return out.filter("a <> b").distinct()


def _at_rest(edges: DataFrame) -> tuple[int, bool]:
    """Number of links, and whether each leads from a root, which is no child, to a child of one root."""
    ends = edges.select(F.col("a").alias("v"), F.lit(1).alias("root"), F.lit(0).alias("child")).unionByName(
        edges.select(F.col("b").alias("v"), F.lit(0).alias("root"), F.lit(1).alias("child"))
    )
    each = ends.groupBy("v").agg(F.max("root").alias("root"), F.sum("child").alias("child"))
    r = each.agg(
        F.sum("child").alias("n"), F.max(F.when((F.col("root") > 0) & (F.col("child") > 0), 1).when(F.col("child") > 1, 1)).alias("bad")
    ).first()
    return int(r["n"] or 0), r["bad"] is None


def components(links: DataFrame, work: Work) -> tuple[DataFrame, int]:
    """``(id, comp)`` for every node of ``links (a, b)`` but the smallest of each component, and their number.

    comp is the smallest node that the node reaches.
    """
    edges = work.keep(
        links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(),
        "links",
    )
    n, rest = _at_rest(edges)
    while not rest:
        after = work.keep(_star(_star(edges, large=True), large=False), "links")
        work.drop(edges)
        edges = after
        n, rest = _at_rest(edges)
    return edges.select(F.col("b").alias("id"), F.col("a").alias("comp")), n
