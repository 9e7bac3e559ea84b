"""Near-dedup of documents by min-max hashing.

Each permutation of the word shingles gives two values, its minimum and its maximum, so 128 values cost 64 hash
evaluations. They form ``BANDS`` bands of ``ROWS`` values: a pair at similarity 0.8 shares no band with a probability of
5e-8. Documents with the same set of shingles are one class from the start; pairs of classes are confirmed on their
full sets, and links become components (`links.link_components`).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MembershipFilter, materialize, release, slices, text_column
from .links import link_components, merged
from .shingles import MinWise, word_shingles

BANDS, ROWS = 32, 4


def _signed(docs: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashing = MinWise(BANDS, ROWS, both=True)
        for batch in slices(batches, limit=1 << 19):
            sets = word_shingles(text_column(batch), width)
            sizes = np.array([len(s) for s in sets], np.int64)
            full = np.flatnonzero(sizes)
            keys = hashing.keys(np.concatenate([sets[i] for i in full]), sizes[full]) if len(full) else np.zeros((0, BANDS), np.int64)
            packed = [b""] * len(sizes)
            for i, row_keys in zip(full.tolist(), keys, strict=True):
                packed[i] = row_keys.tobytes()
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            yield pa.record_batch({"doc_id": batch.column(0), "n_shingles": sizes, "digest": pa.array(digests, pa.binary()), "bands": pa.array(packed, pa.binary())})
        release()

    return docs.mapInArrow(run, "doc_id bigint, n_shingles bigint, digest binary, bands binary")


def near_groups(docs: DataFrame, *, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Documents link where 100 * intersection >= ``percent`` * union of their sets of ``width``-word shingles. Null text is
    empty; a document without words links with nothing and is its own component. A null identifier links with nothing,
    has a null component and is kept. Rows with one identifier are one document: they share a component. Other columns
    of ``docs`` are not read. An empty table gives no rows.
    """
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    signed = materialize(_signed(docs, width), "minmax")
    named = signed.where("doc_id is not null and digest is not null")
    classes = materialize(named.groupBy("digest").agg(F.min("doc_id").alias("id")), "classes")
    reps = named.join(classes, "digest").where("doc_id = id").select("id", "digest", "bands").dropDuplicates(["digest"])
    bands = materialize(reps.select("id", "bands"), "bands")

    def sets(ids: DataFrame) -> DataFrame:
        passes = MembershipFilter(ids, ids.count())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set[tuple[int, str]] = set()
            for batch in batches:
                column = batch.column(0)
                hit = passes(column.fill_null(0).to_numpy()) & column.is_valid().to_numpy(zero_copy_only=False)
                for i in np.flatnonzero(hit):  # rows that repeat identifier and text are sent once
                    row = column[i].as_py(), hash(batch.column(1)[i].as_py())
                    hit[i] = row not in seen
                    seen.add(row)
                for part in slices([batch.filter(pa.array(hit))], limit=1 << 19):
                    found = word_shingles(text_column(part), width)
                    offsets = pa.array(np.r_[0, np.cumsum([len(s) for s in found])], pa.int32())
                    values = pa.array(np.concatenate(found).view(np.int64))
                    yield pa.record_batch({"id": part.column(0), "payload": pa.ListArray.from_arrays(offsets, values)})
            release()

        return docs.mapInArrow(run, "id bigint, payload array<bigint>").join(ids, "id", "left_semi")

    def agree(pairs: DataFrame) -> DataFrame:
        both = F.size(F.array_intersect("x", "y")).cast("bigint")
        return pairs.withColumn("both", both).where((F.col("both") > 0) & (100 * F.col("both") >= percent * (F.size("x") + F.size("y") - F.col("both"))))

    def shingles(column: pa.Array) -> list[np.ndarray]:
        flat, offsets = column.flatten().to_numpy().view(np.uint64), np.diff(column.offsets.to_numpy())
        return np.split(flat, np.cumsum(offsets)[:-1]) if len(column) else []

    labels = link_components(bands, sets, agree, shingles, percent, n_keys=BANDS * bands.count())
    # an identifier that occurs with several sets joins their classes
    owned = named.join(classes, "digest").select("doc_id", "id").distinct()
    first = owned.groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("last")).where("a < last")
    joined = owned.join(first, "doc_id").where("id > a").select("a", F.col("id").alias("b"))
    if not joined.isEmpty():
        labels = merged(labels, joined)
    of_class = classes.join(labels, "id", "left").select("digest", F.coalesce("component", "id").alias("component_id"))
    out = signed.join(of_class, "digest", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
