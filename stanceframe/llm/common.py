"""What the operators of this subpackage share: shared storage, batches of bounded size, and a bounded membership filter."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step handles at once; a longer text is handled alone and whole.
SLICE_BYTES = 2 << 20
#: Bounds of the membership filter that is sent to executors: 2 KB to 32 MB.
FILTER_BITS = (14, 28)
#: Bits of the piece of it that a task sends as one row.
_SEGMENT_BITS = 1 << 19
#: Bits that a key sets in it.
_PROBES = 5
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which driver and executors share; where it is unset (tests), one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jdir.isDefined():
            return jdir.get().rstrip("/")
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="stanceframe-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives lost executors."""
    path = new_path(df.sparkSession, label)
    df.write.options(**{"compression": "zstd", **options}).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the column ``text`` of each holds about ``limit`` bytes (of a list: items); rows stay whole and in order."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        length = pa.compute.list_value_length if pa.types.is_list(column.type) else pa.compute.binary_length
        sizes = np.asarray(pa.compute.fill_null(length(column), 0)).astype(np.int64)
        ends, start = np.cumsum(sizes), 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def release() -> None:
    """Give memory that is free back to the system: a worker that waits for its next task would hold it beside the others."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def text_column(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts of a batch; null counts as empty."""
    return pa.compute.fill_null(batch.column(batch.schema.get_field_index(name)), "").to_pylist()


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit (finaliser of a public 64-bit hash)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _stride(h: np.ndarray) -> np.ndarray:
    return mix64(h ^ np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def _place(h: np.ndarray, g: np.ndarray, i: int, bits: int) -> np.ndarray:
    return (h + np.uint64(i) * g) >> np.uint64(64 - bits)


def _places(keys: np.ndarray, bits: int) -> np.ndarray:
    h = mix64(keys.view(np.uint64))
    g = _stride(h)
    return np.concatenate([_place(h, g, i, bits) for i in range(_PROBES)])


class MembershipFilter:
    """A Bloom filter over a bigint column, built on the executors.

    Only its words (32 MB at most, whatever the input) reach the driver. It never loses a member; where it fills up
    at great sizes it lets more strangers through, which an exact join behind it removes.
    """

    def __init__(self, keys: DataFrame, n_keys: int):
        column = keys.columns[0]
        self.bits = bits = int(min(FILTER_BITS[1], max(FILTER_BITS[0], np.ceil(np.log2(max(1, n_keys) * 10)))))

        size = min(1 << bits, _SEGMENT_BITS)

        def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: dict[int, np.ndarray] = {}
            for batch in batches:
                at = _places(batch.column(0).drop_null().to_numpy(zero_copy_only=False).astype(np.int64), bits).astype(np.int64)
                at.sort()
                for part in np.split(at, np.flatnonzero(np.diff(at // size)) + 1) if len(at) else []:
                    found.setdefault(int(part[0] // size), np.zeros(size, bool))[part % size] = True
            yield pa.record_batch({"segment": pa.array(list(found), pa.int64()), "bits": pa.array([np.packbits(x, bitorder="little").tobytes() for x in found.values()], pa.binary())})

        def union(table: pa.Table) -> pa.Table:
            merged = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in table["bits"].to_pylist()])
            return pa.table({"segment": table["segment"][:1], "bits": pa.array([merged.tobytes()], pa.binary())})

        schema = "segment bigint, bits binary"
        rows = keys.select(column).mapInArrow(segments, schema).groupBy("segment").applyInArrow(union, schema).toArrow()
        whole = np.zeros((1 << bits) // 8, np.uint8)
        for segment, raw in zip(rows["segment"].to_pylist(), rows["bits"].to_pylist(), strict=True):
            whole[segment * size // 8 : (segment + 1) * size // 8] = np.frombuffer(raw, np.uint8)
        self.words = whole.view("<u8")

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.zeros(0, bool)
        h = mix64(np.ascontiguousarray(keys, np.int64).view(np.uint64))
        g, left = _stride(h), np.arange(len(h))
        for i in range(_PROBES):  # most strangers need one look
            at = _place(h[left], g[left], i, self.bits)
            left = left[((self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool)]
        hit = np.zeros(len(h), bool)
        hit[left] = True
        return hit


def without_rows(docs: DataFrame, decisions: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``decisions`` (doc_id, kept and, perhaps, text_sha256) keeps, all columns.

    Only rows that pass a membership filter of what goes are joined, so texts that stay are not shuffled. With
    text_sha256 a decision is on identifier and text, and of rows that repeat both one stays.
    """
    by_text = "text_sha256" in decisions.columns
    keys = ["doc_id", "text_sha256"] if by_text else ["doc_id"]
    decided = decisions.groupBy(*keys).agg(F.max("kept").alias("kept"), F.min("kept").alias("all_kept"))
    gone = materialize(decided.where("not all_kept").select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("kept").alias("__kept")), "gone")
    ids = gone.select("__doc_id").where("__doc_id is not null")
    passes = MembershipFilter(ids, ids.count())

    @F.pandas_udf("boolean")
    def maybe(column: pd.Series) -> pd.Series:
        return pd.Series(passes(column.to_numpy()))

    # a null in a batch would make it float64, which rounds ids above 2^53
    key = F.col(id_col).cast("bigint")
    marked = docs.withColumn("__maybe", maybe(F.coalesce(key, F.lit(0).cast("bigint"))) | key.isNull())
    some = marked.where("__maybe").drop("__maybe").withColumn("__text", F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256))
    same = F.col(id_col).cast("bigint").eqNullSafe(F.col("__doc_id"))
    found = some.join(gone, (same & (F.col("__text") == F.col("__text_sha256"))) if by_text else same, "left")
    stay = found.where("__kept is null")
    if by_text:
        one = found.where("__kept").dropDuplicates(["__doc_id", "__text_sha256"])
        stay = stay.unionByName(one)
    return marked.where("not __maybe").select(*docs.columns).unionByName(stay.select(*docs.columns))
