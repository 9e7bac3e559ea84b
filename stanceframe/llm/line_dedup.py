"""Fuzzy line dedup: MinHash over character shingles.

Each line (cut at line ends, without ASCII white space at its ends, A-Z lower-cased) has the set of its ``WIDTH``-character shingles; a line of fewer
characters is one shingle. ``BANDS`` bands of ``ROWS`` minima propose links (a pair at similarity 0.8 is missed with a
probability of 2e-4, at 0.9 of 1e-7), the sets of the whole lines confirm them, and distributed union-find
(`links.link_components`) makes components, of which the line that comes first by (doc_id, line number) stays.

A task proposes the first of equal lines only and points the others to it, so a line that makes up a third of all lines
sends one row a task. Blank lines take no part and always stay.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import MembershipFilter, materialize, slices, text_column
from .links import link_components
from .shingles import MinWise, char_shingles

WIDTH, BANDS, ROWS, PERCENT = 8, 16, 4, 80
#: Distinct lines that a task points to; beyond it the oldest half is forgotten, which only proposes equal lines twice.
REMEMBERED = 200_000
_NO_LINE = bytes(16)
_LINE = "doc_id bigint, row bigint, line int, id bigint, first bigint, head bigint, tail bigint, bands binary"


def normal_lines(text: str) -> list[bytes]:
    """The lines of a text in UTF-8, A-Z lower-cased, without ASCII white space at their ends; blank ones are empty."""
    return [line.strip() for line in text.encode().lower().split(b"\n")]


def normal(line: str) -> str:
    return line.encode().lower().strip().decode()


def _digest(line: bytes) -> bytes:
    return hashlib.blake2b(line, digest_size=16).digest()


def _halves(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _signed(docs: DataFrame, width: int) -> DataFrame:
    """One row per line that is not blank: its document, its number, its own id, that of the first equal line of the task, a digest, and the first's band keys.

    A document without such a line has one row without number and digest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashing = MinWise(BANDS, ROWS, both=False)
        base = TaskContext.get().partitionId() << 40
        next_id = row = base
        fresh: dict[bytes, int] = {}
        old: dict[bytes, int] = {}
        for batch in slices(batches, limit=1 << 19):
            docs_of, rows_of, numbers, firsts, digests, new, owners = [], [], [], [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), text_column(batch), strict=True):
                before = len(digests)
                for number, line in enumerate(normal_lines(text)):
                    if line:
                        key = _digest(line)
                        first = fresh.get(key)
                        if first is None:
                            first = old.get(key)
                            if first is None:
                                first = next_id + len(digests)
                                owners.append(len(digests))
                                new.append(line.decode())
                            fresh[key] = first
                        docs_of.append(doc_id)
                        rows_of.append(row)
                        numbers.append(number)
                        firsts.append(first)
                        digests.append(key)
                if len(digests) == before:
                    docs_of.append(doc_id)
                    rows_of.append(row)
                    numbers.append(None)
                    firsts.append(next_id + len(digests))
                    digests.append(_NO_LINE)
                row += 1
            if len(fresh) > REMEMBERED:
                fresh, old = {}, fresh
            if not digests:
                continue
            keys = hashing.keys(*char_shingles(new, width)) if new else np.zeros((0, BANDS), np.int64)
            packed: list[bytes] = [b""] * len(digests)
            for i, row_keys in zip(owners, keys, strict=True):
                packed[i] = row_keys.tobytes()
            bands = pa.array(packed, pa.binary())
            head, tail = _halves(digests)
            blank = np.array([n is None for n in numbers])
            head, tail = pa.array(head, mask=blank), pa.array(tail, mask=blank)
            columns = [pa.array(docs_of, pa.int64()), pa.array(rows_of, pa.int64()), pa.array(numbers, pa.int32()), pa.array(np.arange(next_id, next_id + len(digests))), pa.array(firsts, pa.int64()), head, tail, bands]
            next_id += len(digests)
            yield pa.record_batch(columns, names=["doc_id", "row", "line", "id", "first", "head", "tail", "bands"])

    return docs.mapInArrow(run, _LINE)


def similar(pairs: list[tuple[str, str]], width: int = WIDTH, percent: int = PERCENT) -> list[bool]:
    """Whether the shingle sets of the two whole normalised lines of each pair are similar enough."""
    index = {line: i for i, line in enumerate(dict.fromkeys(line for pair in pairs for line in pair))}
    hashes, counts = char_shingles(list(index), width)
    ends, sets = np.cumsum(counts), {}

    def of(line: str) -> np.ndarray:
        i = index[line]
        if i not in sets:
            part = np.sort(hashes[ends[i] - counts[i] : ends[i]])
            sets[i] = part[np.r_[True, part[1:] != part[:-1]]]
        return sets[i]

    out = []
    for a, b in pairs:
        x, y = of(a), of(b)
        if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
            out.append(False)
            continue
        z = np.sort(np.concatenate([x, y]))
        both = int(np.count_nonzero(z[1:] == z[:-1]))
        out.append(100 * both >= percent * (len(x) + len(y) - both))
    return out


def _passing(rows: DataFrame, passes: MembershipFilter, wanted: bool = True) -> DataFrame:
    """The rows whose first column, a bigint without nulls, passes the filter, or the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(passes(batch.column(0).to_numpy()) == wanted))

    return rows.mapInArrow(run, rows.schema)


def line_groups(docs: DataFrame, *, width: int = WIDTH, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per line that is not blank: doc_id, row (of the input, for repeated identifiers), line, component, kept.

    A document without such a line has one row; its line is null.
    """
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    lines = materialize(_signed(docs, width), "lines")

    digests: list[DataFrame] = []

    def equal(ids: DataFrame) -> DataFrame:
        """Equal lines have the same bands; of the copies that tasks proposed only the first goes on."""
        ids = materialize(ids, "shared")
        asked = _passing(lines.select("id", "head", "tail"), MembershipFilter(ids, ids.count()))
        digests.append(materialize(asked.join(ids, "id", "left_semi"), "digests"))
        copies = digests[0].select("id", F.min("id").over(Window.partitionBy("head", "tail")).alias("rep")).where("id <> rep")
        return materialize(copies, "copies")

    def texts(ids: DataFrame) -> DataFrame:
        wanted = materialize(digests[0].join(ids, "id", "left_semi").select("id", "head", "tail"), "wanted")
        passes = MembershipFilter(wanted.select("head"), wanted.count())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set[bytes] = set()
            for batch in slices(batches, limit=1 << 20):
                lines_of = [line for t in text_column(batch) for line in normal_lines(t) if line]
                digests = [*map(_digest, lines_of)]
                out: dict[bytes, bytes] = {}
                for i in np.flatnonzero(passes(_halves(digests)[0])) if digests else ():
                    if digests[i] not in seen:
                        out[digests[i]] = lines_of[i]
                seen.update(out)
                if len(seen) > REMEMBERED:
                    seen.clear()
                head, tail = _halves(list(out)) if out else (np.zeros(0, np.int64),) * 2
                yield pa.record_batch([pa.array(head), pa.array(tail), pa.array([x.decode() for x in out.values()], pa.string())], names=["head", "tail", "payload"])

        found = docs.mapInArrow(run, "head bigint, tail bigint, payload string").join(wanted.select("head", "tail").distinct(), ["head", "tail"], "left_semi")
        found = found.groupBy("head", "tail").agg(F.min("payload").alias("payload"))
        return wanted.join(found, ["head", "tail"]).select("id", "payload")

    def agree(pairs: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(slices(batches, "x"), "y"):
                hit = similar(list(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)), width, percent)
                yield batch.select(["a", "b"]).filter(pa.array(hit, pa.bool_()))

        return pairs.select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")

    def shingles(column: pa.Array) -> list[np.ndarray]:
        hashes, counts = char_shingles(column.to_pylist(), width)
        return [np.unique(s) for s in np.split(hashes, np.cumsum(counts)[:-1])] if len(counts) else []

    proposed = lines.where("octet_length(bands) > 0").select("id", "bands")
    labels = link_components(proposed, texts, agree, shingles, percent, n_keys=BANDS * lines.count(), equal=equal).withColumnRenamed("id", "first")
    # lines that share their place with no other need no join: the filter lets few of them through, and no other stays behind
    labels = materialize(labels, "labels")
    several = labels.select(F.explode(F.array("first", "component")).alias("first")).unionByName(lines.where("id <> first").select("first"))
    passes = MembershipFilter(several, several.count())
    rows = lines.select("first", "doc_id", "row", "line")
    placed = _passing(rows, passes).join(labels, "first", "left").select("doc_id", "row", "line", F.coalesce("component", "first").alias("component"))
    placed = materialize(placed, "placed")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "line")
    best = placed.groupBy("component").agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("n")).where("n > 1").select("component", "best.row", "best.line")
    best = materialize(best.withColumnsRenamed({"row": "best_row", "line": "best_line"}), "best")
    kept = F.col("best_row").isNull() | ((F.col("row") == F.col("best_row")) & (F.col("line") == F.col("best_line")))
    found = placed.join(best, "component", "left").select("doc_id", "row", "line", "component", kept.alias("kept"))
    alone = _passing(rows, passes, False).select("doc_id", "row", "line", F.col("first").alias("component"), F.lit(True).alias("kept"))
    return alone.unionByName(found)


def dedup_lines(docs: DataFrame, *, width: int = WIDTH, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_lines, n_dropped, dropped (line numbers, ascending).

    Lines are numbered from 0, blank ones too; ``n_lines`` counts those that are not blank. A document of blank lines
    only, an empty or a null one has none and drops none. Repeated rows are documents of their own: the lines of the
    later one go. Lines of a null identifier come last in order. Texts and lines of any length are read whole. Other
    columns of ``docs`` are not read; an empty table gives no rows.
    """
    found = line_groups(docs, width=width, percent=percent, id_col=id_col, text_col=text_col)
    dropped = F.array_sort(F.collect_list(F.when(~F.col("kept"), F.col("line"))))
    return found.groupBy("doc_id", "row").agg(F.count("line").alias("n_lines"), dropped.alias("dropped")).select("doc_id", "n_lines", F.size("dropped").cast("bigint").alias("n_dropped"), "dropped")


def without_lines(text: str, dropped: list[int]) -> str:
    """``text`` without the lines of these numbers."""
    gone = set(dropped)
    return "\n".join(line for i, line in enumerate(text.split("\n")) if i not in gone)
