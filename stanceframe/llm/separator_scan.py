"""Token counts of flat, unindexed token files by a separator scan.

A flat file is ids, one after another, with an end-of-document id behind each document. Files are read in blocks; a
vectorised search finds the end ids of a block, and a document that crosses blocks is stitched by a prefix scan over
one narrow row per block: how many end ids came before it, and where the last of them was.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, new_path, slices, text_column
from .files import read_range, written_whole
from .tokens import ChunkEncoder

#: Ids of a block.
BLOCK_IDS = 1 << 20


def write_flat(docs: DataFrame, path: str, tokenizer: str, *, cut: str = "leading", end_id: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Write one flat file per input partition. Returns files (file, path, n_ids) and, for naming what a scan finds, the order (file, ordinal, doc_id).

    The strings of special tokens are ordinary text, so ``end_id`` stands only at ends. Null text is empty.
    """
    encoder = ChunkEncoder.of(tokenizer, cut, True)
    width = 2 if encoder.library.get_vocab_size(True) <= 1 << 16 and end_id < 1 << 16 else 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, file, n, total = ChunkEncoder.of(tokenizer, cut, True), TaskContext.get().partitionId(), 0, 0
        end = np.array([end_id], f"<u{width}").tobytes()
        with written_whole(f"{path}/{file:08d}.ids") as out:
            for batch in slices(batches):
                ids = [np.frombuffer(x, "<u4").astype(f"<u{width}").tobytes() for x in encoder.encode(text_column(batch))]
                data = end.join([*ids, b""])
                out.write(data)
                yield pa.record_batch({"file": pa.array([file] * len(ids), pa.int64()), "ordinal": np.arange(n, n + len(ids)), "doc_id": batch.column(0)})
                n, total = n + len(ids), total + len(data) // width
        yield pa.record_batch({"file": pa.array([file], pa.int64()), "ordinal": pa.array([-1], pa.int64()), "doc_id": pa.array([total], pa.int64())})

    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    rows = materialize(docs.mapInArrow(run, "file bigint, ordinal bigint, doc_id bigint"), "flat-order")
    files = rows.where("ordinal = -1").select("file", F.format_string(f"{path.replace('%', '%%')}/%08d.ids", "file").alias("path"), F.col("doc_id").alias("n_ids"), F.lit(width).alias("width"))
    return files, rows.where("ordinal >= 0")


def scan(files: DataFrame, end_id: int, block_ids: int = BLOCK_IDS) -> DataFrame:
    """One row per document in flat files (file, path, n_ids, width): file, ordinal, start, n_tokens, ended.

    ``n_tokens`` leaves the end id out. Ids behind the last end id of a file are a document with ``ended`` false. A file
    without ids has no documents; two end ids in a row enclose a document of 0 tokens.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, path, n_ids, width, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                first = block * block_ids
                ids = np.frombuffer(read_range(path, first * width, min(block_ids, n_ids - first) * width), f"<u{width}")
                at = first + np.flatnonzero(ids == end_id)
                yield pa.record_batch({"file": pa.array([file], pa.int64()), "block": pa.array([block], pa.int64()), "ends": pa.array([at], pa.list_(pa.int64()))})

    blocks = files.where("n_ids > 0").select("file", "path", "n_ids", "width", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(n_ids - 1) div {block_ids}"))).alias("block"))
    n = max(1, blocks.count())
    found = materialize(blocks.repartition(min(n, 4 * files.sparkSession.sparkContext.defaultParallelism + n // 64), "file", "block").mapInArrow(run, "file bigint, block bigint, ends array<bigint>"), "separator-blocks")

    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ends_of = found.select("file", "block", F.size("ends").cast("bigint").alias("n"), F.expr("get(ends, size(ends) - 1)").alias("last"))
    carry = ends_of.select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.coalesce(F.max("last").over(before), F.lit(-1)).alias("last"))
    starts = F.expr("transform(concat(array(last), slice(ends, 1, greatest(0, size(ends) - 1))), x -> x + 1)")
    whole = (
        found.where("size(ends) > 0").join(carry, ["file", "block"])
        .select("file", "before", F.posexplode(F.arrays_zip(F.col("ends").alias("end"), starts.alias("start"))).alias("i", "d"))
        .select("file", (F.col("before") + F.col("i")).alias("ordinal"), F.col("d.start").alias("start"), (F.col("d.end") - F.col("d.start")).alias("n_tokens"), F.lit(True).alias("ended"))
    )
    closed = ends_of.groupBy("file").agg(F.sum("n").alias("n"), F.coalesce(F.max("last"), F.lit(-1)).alias("last"))
    tail = closed.join(files.select("file", "n_ids"), "file").where("n_ids > last + 1").select("file", F.col("n").alias("ordinal"), (F.col("last") + 1).alias("start"), (F.col("n_ids") - F.col("last") - 1).alias("n_tokens"), F.lit(False).alias("ended"))
    return whole.unionByName(tail)


def count_documents(docs: DataFrame, tokenizer: str, *, end_id: int, cut: str = "leading", block_ids: int = BLOCK_IDS, **columns) -> DataFrame:
    """Write ``docs`` as flat files, scan them, and name what was found: doc_id, file, ordinal, start, n_tokens.

    One row per input row, repeated ones too; a null identifier stays null. Other columns are not read. An empty table
    gives no rows.
    """
    files, order = write_flat(docs, new_path(docs.sparkSession, "flat-files"), tokenizer, cut=cut, end_id=end_id, **columns)
    return scan(files, end_id, block_ids).join(order, ["file", "ordinal"]).select("doc_id", "file", "ordinal", "start", "n_tokens")
