"""Token-id files: Parquet with list columns, in order of the documents.

Each file holds a range of documents, sorted by key. Ids are a list column, with
dictionary pages (two bytes an id or less) or delta encoding; keys, counts and
starts are delta encoded. Row groups and pages have set sizes, and the writer leaves
page indexes, so a reader of some documents or of the metadata columns alone skips
the pages of the rest.

Ids come from the tokenizers library. BPE never merges across the words that the
tokenizer's pattern cuts, so each task gives the library every distinct word once
and puts whole texts together from the results; each block is decoded and compared
with its bytes.

``start`` counts the ids of all documents before. Inside a file it is added up while
the file is written; a file's own start is the sum of the files before it, one row
per file.

Defined results: null is the empty text, which has the end id only; a null key comes
first; rows of one key stand together, by the hash of their texts, and count apart. An
empty table gives files without rows. Other columns are kept, but for those called ``ids``,
``n_tokens``, ``start``, ``file_no`` or ``file_start``, which the files need for themselves.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

from rasterdrill.llm import bpe
from rasterdrill.llm import text as T

ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10
PAGE_ROWS = 2000
# Words given to the library in one call.
_CALL = 8192
# Files whose totals may be broadcast: 16 bytes each.
BROADCAST_FILES = 1_000_000

_OWN = ("file_no", "file_start", "n_tokens", "ids")


def library_words(path: str, model: bpe.Model):
    """A function that encodes words, cut by the pattern already, with the library."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()

    def run(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = data.tobytes()
        words = [raw[a:b].decode("utf-8", "replace") for a, b in zip(start.tolist(), end.tolist())]
        tokens, counts = [], []
        for i in range(0, len(words), _CALL):
            part = words[i : i + _CALL]
            got = tok.encode_batch_fast([part], is_pretokenized=True, add_special_tokens=False)[0]
            ids = np.array(got.ids, np.int64)
            ends = np.cumsum(end[i : i + _CALL] - start[i : i + _CALL])
            tokens.append(ids)
            counts.append(np.diff(np.searchsorted(np.cumsum(model.size[ids]), ends) + 1, prepend=0))
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(tokens), np.concatenate(counts)

    return run


def write_tokens(
    docs: DataFrame, to: str, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = 0,
    encoding: str = "dictionary", row_group_bytes: int = ROW_GROUP_BYTES, page_bytes: int = PAGE_BYTES,
    page_rows: int = PAGE_ROWS, files: int | None = None,
) -> None:
    """Write ``to`` with the key, the other columns but the text, and the ids with ``end_id``."""
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"no such encoding: {encoding}")
    spark = docs.sparkSession
    meta = [c for c in docs.columns if c not in (*_OWN, text)]
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(key), F.xxhash64(text)]
    rows = docs.select(*meta, text).repartitionByRange(files, *order).sortWithinPartitions(*order)
    schema = S.StructType([f for f in rows.schema if f.name != text])
    for name, kind in zip(_OWN, (S.IntegerType(), S.LongType(), S.LongType(), S.ArrayType(S.IntegerType())), strict=True):
        schema = schema.add(name, kind)
    model = spark.sparkContext.broadcast(bpe.load(tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = bpe.Encoder(model.value, library_words(tokenizer, model.value))
        number, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            data, offsets = T.flat(batch.column(len(meta)))
            for a, b in T.blocks(offsets):
                token, at = one.block(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                n = b - a
                ids = np.insert(token, at[1:], np.int32(end_id))
                at = at + np.arange(n + 1)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(i).slice(a, n) for i in range(len(meta))),
                        pa.array(np.full(n, number, np.int32)), pa.array(before + at[:-1]), pa.array(np.diff(at)),
                        bpe._list_column(ids, at),
                    ],
                    schema.names,
                )
                before += int(at[-1])

    of_ids = "true" if encoding == "dictionary" else "false"
    writer = rows.mapInArrow(run, schema).write.mode("overwrite")
    options = {
        "compression": "zstd",
        "parquet.writer.version": "PARQUET_2_0",
        "parquet.block.size": row_group_bytes,
        "parquet.page.size": page_bytes,
        "parquet.page.row.count.limit": page_rows,
        "parquet.enable.dictionary#ids.list.element": of_ids,
        f"parquet.enable.dictionary#{key}": "false",
        "parquet.enable.dictionary#file_start": "false",
        "parquet.enable.dictionary#n_tokens": "false",
    }
    writer.options(**options).parquet(to)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Documents of a token-id table with their ``start``; without ids, only metadata pages are read."""
    rows = spark.read.parquet(path)
    totals = rows.groupBy(F.col("file_no").alias("_file")).agg(F.sum("n_tokens").alias("_n"))
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    starts = totals.select("_file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    few = totals.count() <= BROADCAST_FILES
    out = rows.join(F.broadcast(starts) if few else starts, F.col("file_no") == F.col("_file"))
    out = out.withColumn("start", F.col("file_start") + F.col("_before"))
    out = out.drop("_file", "_before", "file_no", "file_start")
    return out if with_ids else out.drop("ids")


def checksums(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, start, n_tokens, ids_crc32``: crc32 of the ids as little-endian 32-bit integers."""
    schema = f"{key} bigint, start bigint, n_tokens bigint, ids_crc32 bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(3)
            at = ids.offsets.to_numpy()
            raw = ids.values.to_numpy(zero_copy_only=False).astype("<u4").tobytes()
            cut = (4 * at.astype(np.int64)).tolist()
            crc = [zlib.crc32(raw[i:j]) for i, j in zip(cut, cut[1:])]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(crc, pa.int64())], [key, "start", "n_tokens", "ids_crc32"])

    return rows.select(F.col(key).cast("bigint"), "start", "n_tokens", "ids").mapInArrow(run, schema)
