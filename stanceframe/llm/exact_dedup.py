"""Exact dedup by a log-structured merge index.

1. *Memtables.* Each task digests its rows (SHA-256 of the UTF-8 text) into a memtable; a full one is flushed as a run
   sorted by digest, with a Parquet Bloom filter and the min/max of its row groups.
2. *Compaction.* Runs are merged in the order of their digests. Equal digests of a run are one entry before anything is
   shuffled, so a text that makes up a third of all rows is one entry a run. The row that stays is the one with the
   smallest (or largest) identifier.
3. *Byte verification.* Digests of more than one row form a bounded membership filter; a second scan sends only the texts
   that pass it, one copy a task, and every text of a digest must equal the others. Two texts with one
   digest would stop the job with an error instead of dropping one.

`MergeIndex` keeps the levels between batches: a batch is one level more, its digests are looked for in the earlier ones
behind a filter, and when a tier has ``fanout`` levels they are merged into one of the next.

Shuffled are digests and one copy a task of repeated texts, never the corpus.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MembershipFilter, materialize, slices, text_column
from .files import list_names, read_range, write_bytes

#: Rows of a memtable.
MEMTABLE_ROWS = 200_000
#: Bytes of repeated texts that a task keeps at hand while it verifies.
SEEN_BYTES = 32 << 20
#: Entries of a level that a task merges, about.
LEVEL_ROWS = 2_000_000
_ROW = "doc_id bigint, run bigint, pos bigint, digest binary"
_ENTRY = "digest binary, doc_id bigint, run bigint, pos bigint, n bigint"
_BLOOM = {"parquet.bloom.filter.enabled#digest": "true"}
#: The first eight bytes of a digest as a number.
_HEAD = "cast(conv(hex(substring(digest, 1, 8)), 16, -10) as bigint)"


def _digests(texts: list[str]) -> list[bytes]:
    return [hashlib.sha256(t.encode()).digest() for t in texts]


def flush_runs(docs: DataFrame, normalise: Callable[[str], str] | None = None, memtable_rows: int = MEMTABLE_ROWS, *, keep: str = "smallest", batch: int = 0) -> DataFrame:
    """(doc_id, run, pos, digest) of every row: sorted by digest within each run, the row to keep first. (run, pos) is the
    row's address."""
    order = [("digest", "ascending"), ("doc_id", {"smallest": "ascending", "largest": "descending"}[keep]), ("pos", "ascending")]

    def flush(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, pos, held, rows = (batch << 44) + (TaskContext.get().partitionId() << 24), 0, [], 0
        flushed = 0

        def sorted_run() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).sort_by(order)  # nulls last
            run = pa.array(np.full(table.num_rows, first + flushed, np.int64))
            return table.append_column("run", run).select(["doc_id", "run", "pos", "digest"]).combine_chunks().to_batches()[0]

        for part in slices(batches):
            texts = text_column(part)
            digests = _digests([normalise(t) for t in texts] if normalise else texts)
            held.append(pa.record_batch({"doc_id": part.column(0).cast(pa.int64()), "pos": pa.array(np.arange(pos, pos + len(texts))), "digest": pa.array(digests, pa.binary())}))
            pos, rows = pos + len(texts), rows + len(texts)
            if rows >= memtable_rows:
                yield sorted_run()
                held, rows, flushed = [], 0, flushed + 1
        if held:
            yield sorted_run()

    return docs.mapInArrow(flush, _ROW)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbours with one digest become one entry: the first, with the sum of their sizes."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.table(batch.columns, names=batch.schema.names)  # whether Spark calls a column nullable varies
        table = pa.concat_tables([held, table]).combine_chunks() if held is not None else table
        digest = np.frombuffer(b"".join(table["digest"].to_pylist()), "<u8").reshape(-1, 4)
        heads = np.flatnonzero(np.r_[True, (digest[1:] != digest[:-1]).any(axis=1)])
        merged = table.take(pa.array(heads)).set_column(4, "n", pa.array(np.add.reduceat(table["n"].to_numpy(), heads)))
        # the last may go on in the next batch
        held = merged.slice(len(heads) - 1)
        yield from merged.slice(0, len(heads) - 1).to_batches()
    if held is not None:
        yield from held.to_batches()


def entries(runs: DataFrame) -> DataFrame:
    """Entries (digest, doc_id, run, pos, n) of sorted runs, one a digest and run, but where a run is read in parts."""
    return runs.select("digest", "doc_id", "run", "pos", F.lit(1).cast("bigint").alias("n")).mapInArrow(_merge, _ENTRY)


def compact(parts: DataFrame, keep: str = "smallest", n_entries: int | None = None) -> DataFrame:
    """Merge entries in the order of their digests: one a digest, its size and the row that stays, sorted.

    Of equal identifiers the first row by address stays; a null one never does while there is another. Digests are
    uniform, so equal ranges of them are equal shares.
    """
    ranges = max(1, -(-(parts.count() if n_entries is None else n_entries) // LEVEL_ROWS))
    share = F.expr(f"cast(conv(hex(substring(digest, 1, 3)), 16, 10) as bigint) * {ranges} div 16777216")
    order = F.col("doc_id").asc_nulls_last() if keep == "smallest" else F.col("doc_id").desc_nulls_last()
    dealt = parts.repartition(ranges, share) if ranges > 1 else parts.repartition(1)
    return dealt.sortWithinPartitions("digest", order, "run", "pos").mapInArrow(_merge, _ENTRY)


def verify_hits(docs: DataFrame, repeated: DataFrame, normalise: Callable[[str], str] | None = None) -> DataFrame:
    """Digests that belong to different texts; empty unless SHA-256 collides."""
    passes = MembershipFilter(repeated.select(F.expr(_HEAD).alias("k")), repeated.count())

    def one_copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, bytes] = {}
        held = 0
        for batch in slices(batches):
            texts = text_column(batch)
            texts = [normalise(t) for t in texts] if normalise else texts
            digests, out = _digests(texts), []
            for i in np.flatnonzero(passes(np.frombuffer(b"".join(d[:8] for d in digests), ">i8").astype(np.int64))):
                raw = texts[i].encode()
                if seen.get(digests[i]) != raw:  # what equals the copy at hand, byte for byte, needs no shuffle
                    seen[digests[i]] = raw
                    held += len(raw)
                    out.append(i)
            if held > SEEN_BYTES:
                seen, held = {}, 0
            yield pa.record_batch({"digest": pa.array([digests[i] for i in out], pa.binary()), "text": pa.array([texts[i] for i in out], pa.string())})

    sent = docs.mapInArrow(one_copy, "digest binary, text string")
    return sent.groupBy("digest").agg(F.min("text").alias("lo"), F.max("text").alias("hi")).where("lo <> hi").select("digest")


def _decided(runs: DataFrame, level: DataFrame) -> DataFrame:
    """The rows of runs with what the level says of their digests; a digest that it holds once needs no join."""
    of = level.where("n > 1").select(F.col("digest").alias("__digest"), F.col("doc_id").alias("keep_id"), F.col("run").alias("keep_run"), F.col("pos").alias("keep_pos"), "n")
    rows = runs.join(of, F.col("digest") == F.col("__digest"), "left")
    alone = F.col("n").isNull()
    kept = alone | ((F.col("run") == F.col("keep_run")) & (F.col("pos") == F.col("keep_pos")))
    return rows.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("n", F.lit(1)).cast("bigint").alias("group_size"), kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def _checked(docs: DataFrame, level: DataFrame, normalise: Callable[[str], str] | None) -> None:
    if not verify_hits(docs, level.where("n > 1"), normalise).isEmpty():
        raise ArithmeticError("two different texts share a SHA-256 digest")


def exact_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", normalise: Callable[[str], str] | None = None, memtable_rows: int = MEMTABLE_ROWS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty, and empty texts form a group like any other. Of rows that repeat both identifier and text
    exactly one is kept. A null identifier never stays while another one of its group can; identifiers may be any bigint.
    Texts of any length are digested and compared whole. Other columns of ``docs`` are not read, whatever their names. An
    empty table gives no rows.
    """
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    runs = materialize(flush_runs(docs, normalise, memtable_rows, keep=keep), "lsm-runs", **_BLOOM)
    level = materialize(compact(entries(runs), keep, runs.count()), "lsm-level", **_BLOOM)
    _checked(docs, level, normalise)
    return _decided(runs, level)


class MergeIndex:
    """Levels of digests in a folder of shared storage, for documents that come in batches.

    Each version of the list of levels is a small file of its own that appears whole, so a batch that dies leaves the
    index as it was. One batch is added at a time.
    """

    def __init__(self, spark: SparkSession, path: str, *, keep: str = "smallest", fanout: int = 4):
        self.spark, self.path, self.keep, self.fanout = spark, path.rstrip("/"), keep, fanout

    def _version(self) -> tuple[int, list[list]]:
        """The number of batches, and (tier, folder) of each level."""
        names = sorted(n for n in list_names(self.path) if n.startswith("LEVELS-") and not n.endswith(".part"))
        if not names:
            return 0, []
        return int(names[-1].removeprefix("LEVELS-")), json.loads(read_range(f"{self.path}/{names[-1]}", 0))

    def levels(self) -> list[DataFrame]:
        return [self.spark.read.schema(_ENTRY).parquet(f"{self.path}/{folder}") for _, folder in self._version()[1]]

    def _write(self, level: DataFrame, folder: str) -> DataFrame:
        level.write.mode("overwrite").options(compression="zstd", **_BLOOM).parquet(f"{self.path}/{folder}")
        return self.spark.read.schema(_ENTRY).parquet(f"{self.path}/{folder}")

    def add(self, docs: DataFrame, earlier: DataFrame | None = None, *, id_col: str = "doc_id", text_col: str = "text", normalise: Callable[[str], str] | None = None) -> DataFrame:
        """As `exact_groups`, for a batch and all batches before it: a row is kept where its group has no row to keep
        before it. ``earlier`` (the same columns) holds the documents of former batches, with which hits are compared."""
        frames = [f.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")) for f in (docs, earlier) if f is not None]
        batch, known = self._version()
        runs = materialize(flush_runs(frames[0], normalise, keep=self.keep, batch=batch), "lsm-runs", **_BLOOM)
        fresh = self._write(compact(entries(runs), self.keep, runs.count()), f"level-{batch:09d}-0")
        n = fresh.count()
        view = fresh
        if known and n:
            passes = MembershipFilter(fresh.select(F.expr(_HEAD).alias("k")), n)

            def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for part in batches:
                    heads = np.frombuffer(b"".join(d[:8] for d in part.column(0).to_pylist()), ">i8").astype(np.int64)
                    yield part.filter(pa.array(passes(heads)))

            for level in self.levels():
                view = view.unionByName(level.mapInArrow(probe, _ENTRY).join(fresh.select("digest"), "digest", "left_semi").select(*fresh.columns))
            view = materialize(compact(view, self.keep, n), "lsm-view", **_BLOOM)
        _checked(frames[0] if earlier is None else frames[0].unionByName(frames[1]), view, normalise)
        levels = [*known, [0, f"level-{batch:09d}-0"]]
        tier = 0
        while len(full := [f for t, f in levels if t == tier]) >= self.fanout:
            merged = self.spark.read.schema(_ENTRY).parquet(*[f"{self.path}/{f}" for f in full])
            self._write(compact(merged, self.keep), f"level-{batch:09d}-{tier + 1}")
            levels = [x for x in levels if x[0] != tier] + [[tier + 1, f"level-{batch:09d}-{tier + 1}"]]
            tier += 1
        write_bytes(f"{self.path}/LEVELS-{batch + 1:09d}", json.dumps(levels).encode())
        return _decided(runs, view)

    def lookup(self, digests: list[bytes]) -> DataFrame:
        """Entries of a few digests over all levels; row groups that cannot hold them are skipped by their filters."""
        found = [lookup(level, digests) for level in self.levels()]
        out = found[0]
        for frame in found[1:]:
            out = out.unionByName(frame)
        return compact(out, self.keep, 1)


def lookup(level: DataFrame, digests: list[bytes]) -> DataFrame:
    """Entries of a written level for a few digests; runs and row groups that cannot hold them are skipped by their filters."""
    return level.where(F.col("digest").isin([bytearray(d) for d in digests]))
