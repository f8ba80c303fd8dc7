"""Exact top-k inner products by descending length, with rotated partial sums.

Vectors are whole numbers, so scores are exact. The second-moment matrix of all
vectors is summed on Spark; its eigenvectors (the right singular vectors of the
table) rotate every vector so that the first coordinates hold most of it. Rows are
dealt by length, and each task takes them longest first:

* if |q| |x| is below the query's k-th best so far, so is every shorter vector;
* else the product of the first coordinates plus |q'| |x'| of the others bounds the
  score (Cauchy-Schwarz), and only pairs that may reach the k-th best are scored.

A query's k-th best score among the ``SEEDS`` longest vectors is where each task
starts, so tasks of short vectors prune from their first block. Bounds carry a slack
for rounding; every returned score is an integer product.

Queries are a stated set, taken ``QUERY_BLOCK`` at a time against all rows. A task
returns at most k rows per query. Vectors that are null, empty or hold a null or
non-finite component take no part; vectors of another length than a query's are not
its candidates. Ties go to the smaller id. Rows that bear a query's id are its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterdrill.llm.store import Work

# Queries in one broadcast: 8 bytes a component, 32 MB at 1,024 components.
QUERY_BLOCK = 4096
# Longest vectors that give each query its first threshold.
SEEDS = 512
# Vectors scored at once inside a task.
ROW_BLOCK = 1024
# Vectors a task holds at once; it starts anew with the next ones, so memory is bounded.
TASK_ROWS = 65_536
# Share of the squared length that the first coordinates should hold.
HEAD_SHARE = 0.8


def whole(vector: Column, scale: float) -> Column:
    """floor(scale * x) of each component; null where the vector takes no part."""
    fine = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    out = F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("bigint"))
    return F.when(fine & (F.size(vector) > 0), out)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return values.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def rotation(vectors: DataFrame, dim: int) -> np.ndarray:
    """Eigenvectors of the sum of x xᵀ over all rows, by falling eigenvalue.

    Each task returns one matrix of dim * dim values; they are added on Spark.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column("v"), dim).astype(np.float64)
                total += x.T @ x
        at = np.arange(dim * dim, dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel())], ["at", "s"])

    sums = vectors.mapInArrow(partial, "at int, s double").groupBy("at").agg(F.sum("s").alias("s"))
    flat = np.zeros(dim * dim)
    for r in sums.collect():  # dim * dim numbers, whatever the table
        flat[r["at"]] = r["s"]
    m = flat.reshape(dim, dim)
    if not np.isfinite(m).all():
        return np.eye(dim)
    _, axes = np.linalg.eigh((m + m.T) / 2)
    return np.ascontiguousarray(axes[:, ::-1])


class _Search:
    """Pruned search of one set of queries in vectors given longest first."""

    def __init__(self, ids, queries, axes, floor, k):
        self.ids, self.q, self.axes, self.k = ids, queries, axes, k
        self.turned = queries.astype(np.float64) @ axes
        self.length = np.sqrt((self.turned**2).sum(1))
        share = np.cumsum((self.turned**2).sum(0))
        self.head = int(np.searchsorted(share, HEAD_SHARE * share[-1])) + 1 if share[-1] > 0 else 1
        self.rest = np.sqrt((self.turned[:, self.head :] ** 2).sum(1))
        self.floor = floor.copy()  # k-th best so far, a lower bound of the final one
        self.best: list[tuple[np.ndarray, np.ndarray]] = [
            (np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in ids
        ]
        self.open = np.arange(len(ids))
        self.scored = 0

    def run(self, vec_ids: np.ndarray, x: np.ndarray) -> None:
        """``x`` by falling length."""
        exact = max(1.0, float(np.abs(x).max(initial=0))) * max(1.0, float(np.abs(self.q).max(initial=0)))
        small = exact * x.shape[1] < 2**52  # then float products are exact
        self.open = np.arange(len(self.ids))
        for a in range(0, len(x), ROW_BLOCK):
            part, own = x[a : a + ROW_BLOCK], vec_ids[a : a + ROW_BLOCK]
            turned = part.astype(np.float64) @ self.axes
            length = np.sqrt((turned**2).sum(1))
            slack = 1e-9 * (1 + self.length * length.max())
            self.open = self.open[self.length[self.open] * length.max() + slack[self.open] >= self.floor[self.open]]
            if not len(self.open):
                return
            rest = np.sqrt((turned[:, self.head :] ** 2).sum(1))
            o = self.open
            bound = self.turned[o, : self.head] @ turned[:, : self.head].T
            bound += self.rest[o, None] * rest[None, :] + slack[o, None]
            qi, xi = np.nonzero(bound >= self.floor[o, None])
            qi = o[qi]
            off = own[xi] != self.ids[qi]
            qi, xi = qi[off], xi[off]
            self.scored += len(qi)
            if small:
                score = np.empty(len(qi), np.int64)
                for s in range(0, len(qi), 1 << 16):
                    e = s + (1 << 16)
                    score[s:e] = np.einsum(
                        "ij,ij->i", self.q[qi[s:e]].astype(np.float64), part[xi[s:e]].astype(np.float64)
                    ).astype(np.int64)
            else:
                score = np.array(
                    [sum(int(u) * int(v) for u, v in zip(self.q[i], part[j])) for i, j in zip(qi, xi)], np.int64
                )
            cut = np.searchsorted(qi, np.arange(len(self.ids) + 1))
            for i in np.flatnonzero(np.diff(cut)):
                sc, vi = self.best[i]
                sc = np.concatenate([sc, score[cut[i] : cut[i + 1]]])
                vi = np.concatenate([vi, own[xi[cut[i] : cut[i + 1]]]])
                top = np.lexsort((vi, -sc))[: self.k]
                self.best[i] = sc[top], vi[top]
                if len(top) == self.k:
                    self.floor[i] = max(self.floor[i], sc[top[-1]])


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", work: Work | None = None
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best rows of ``vectors`` for each query.

    Both frames have ``key`` and ``v``, an array of bigint or null (see :func:`whole`).
    Rows of ``vectors`` with a null key take no part; nor do such queries.
    """
    spark = vectors.sparkSession
    work = work or Work(spark, "topk")
    rows = vectors.select(F.col(key).cast("bigint").alias("vec_id"), "v").filter("vec_id IS NOT NULL AND v IS NOT NULL")
    asked = queries.select(F.col(key).cast("bigint").alias("vec_id"), "v").filter("vec_id IS NOT NULL AND v IS NOT NULL")
    out = None
    schema = "query_id bigint, vec_id bigint, score bigint"
    for d in sorted(r["d"] for r in asked.select(F.size("v").alias("d")).distinct().collect()):
        at_d = F.size("v") == d
        length = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
        held = rows.filter(at_d).withColumn("n2", length)
        axes = rotation(held, d)
        seeds = held.orderBy(F.desc("n2"), "vec_id").limit(SEEDS).toPandas()
        parts = spark.sparkContext.defaultParallelism
        dealt = held.repartitionByRange(max(parts, int(spark.conf.get("spark.sql.shuffle.partitions"))), F.desc("n2"), "vec_id")
        dealt = dealt.sortWithinPartitions(F.desc("n2"), "vec_id")
        of_d = asked.filter(at_d).dropDuplicates(["vec_id", "v"])
        n_blocks = max(1, -(-of_d.count() // (QUERY_BLOCK // 2)))
        for block in range(n_blocks):
            mine = of_d.filter(F.pmod(F.xxhash64("vec_id", F.lit(d)), F.lit(n_blocks)) == block).toPandas()
            if not len(mine):
                continue
            ids = mine["vec_id"].to_numpy(np.int64)
            q = np.array(mine["v"].tolist(), np.int64).reshape(-1, d)
            first = _Search(ids, q, axes, np.full(len(ids), -np.inf), k)
            if len(seeds):
                first.run(seeds["vec_id"].to_numpy(np.int64), np.array(seeds["v"].tolist(), np.int64).reshape(-1, d))
            shared = spark.sparkContext.broadcast((ids, q, axes, first.floor))

            def search(batches: Iterator[pa.RecordBatch], shared=shared, d=d) -> Iterator[pa.RecordBatch]:
                ids, q, axes, floor = shared.value
                one, held_rows = _Search(ids, q, axes, floor, k), []
                n = 0

                def flush():
                    nonlocal n
                    if held_rows:
                        one.run(
                            np.concatenate([b.column("vec_id").to_numpy() for b in held_rows]),
                            np.concatenate([_matrix(b.column("v"), d) for b in held_rows]),
                        )
                        held_rows.clear()
                        n = 0

                for b in batches:
                    if b.num_rows:
                        held_rows.append(b)
                        n += b.num_rows
                        if n >= TASK_ROWS:
                            flush()
                flush()
                for i, (score, vec) in enumerate(one.best):
                    if len(score):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(score), ids[i])), pa.array(vec), pa.array(score)],
                            ["query_id", "vec_id", "score"],
                        )

            found = dealt.mapInArrow(search, schema)
            if n_blocks > 1:
                found = work.keep(found, "block")
                shared.destroy()
            out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], schema)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        out.withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
