"""Nearest vectors by blocks: products of matrices tell what may be nearest, and only that is scored number by number.

A block is bounded, so a task's memory is, and every two blocks that meet are a task of their own.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Vectors of a block, rows of one product, and how far a product may lie from the score it stands for (float64: 1e-14).
BLOCK, ROWS, SLACK = 16_384, 256, 1e-9


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """The vectors of a column as rows of float64."""
    lists = column.combine_chunks()
    sizes = pc.unique(pc.list_value_length(lists))
    if len(lists) and (lists.null_count or len(sizes) != 1):
        raise ValueError("vectors differ in size")
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1 if len(lists) and sizes[0].as_py() else 0)


def units(m: np.ndarray) -> np.ndarray:
    """Rows of length 1; zeros where a row has none or is not finite."""
    with np.errstate(all="ignore"):
        u = m / np.sqrt((m * m).sum(axis=1, keepdims=True))
    u[~np.isfinite(u).all(axis=1)] = 0.0
    return u


def size_of(v: list[float]) -> float:
    return math.sqrt(sum(x * x for x in v))


def score_of(v: list[float], size: float, w: list[float], other: float) -> float:
    return sum(x * y for x, y in zip(v, w, strict=True)) / (size * other) if size and other else 0.0


def kept(df: DataFrame) -> DataFrame:
    """Computed once, in ``spark.checkpoint.dir``; where that is unset, on the executors."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.localCheckpoint()


class _Seeds:
    """Vectors of seeds in order, with room for all of a block."""

    def __init__(self, m: np.ndarray, u: np.ndarray) -> None:
        self.m, self.u, self.rows, self.of, self.sizes = m, u, np.empty_like(u), [], []

    def add(self, i: int) -> None:
        self.rows[len(self.of)] = self.u[i]
        self.of.append(i)
        self.sizes.append(None)

    def score(self, k: int, v: list[float], size: float) -> float:
        w = self.m[self.of[k]].tolist()
        if self.sizes[k] is None:
            self.sizes[k] = size_of(w)
        return score_of(v, size, w, self.sizes[k])


FOUND = "entity_type string, at int, score double, seed_at int, seed string"
SETTLED = "entity_type string, form string, seed string, at int, vector array<double>"


def nearest_seeds(threshold: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """For forms (entity_type, at, vector) the nearest of earlier seeds (form, at, vector) at the threshold; of equals the later."""

    def run(forms: pa.Table, seeds: pa.Table) -> pa.Table:
        found = []
        if len(forms) and len(seeds):
            seeds = seeds.sort_by("at")
            m, w = matrix(forms["vector"]), matrix(seeds["vector"])
            if m.shape[1] != w.shape[1]:
                raise ValueError("vectors differ in size")
            u, taken = units(m), _Seeds(w, units(w))
            for k in range(len(w)):
                taken.add(k)
            at, seed_at, names = forms["at"].to_pylist(), seeds["at"].to_pylist(), seeds["form"]
            for lo in range(0, len(m), ROWS):
                near = u[lo : lo + ROWS] @ taken.u.T
                tops = near.max(axis=1)
                for i in np.nonzero(tops >= threshold - SLACK)[0]:
                    v = m[lo + i].tolist()
                    best, last = threshold, None
                    for k in np.nonzero(near[i] >= max(threshold, tops[i]) - SLACK)[0]:
                        if (score := taken.score(k, v, size_of(v))) >= best:
                            best, last = score, k
                    if last is not None:
                        found.append((at[lo + i], best, seed_at[last], names[int(last)].as_py()))
        kind = forms["entity_type"][0].as_py() if len(forms) else None
        columns = list(zip(*found, strict=True)) if found else [(), (), (), ()]
        types = (pa.int32(), pa.float64(), pa.int32(), pa.string())
        return pa.table([pa.array([kind] * len(found), pa.string()), *map(pa.array, columns, types)], names=["entity_type", "at", "score", "seed_at", "seed"])

    return run


def settle(threshold: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The forms of a block (entity_type, form, at, vector) in order: each joins the nearest seed before it, found (FOUND)
    or of this block, else it is one and keeps its vector."""

    def run(forms: pa.Table, found: pa.Table | None) -> pa.Table:
        forms = forms.sort_by("at")
        known: dict[int, tuple] = {}
        for at, *x in zip(*(found[c].to_pylist() for c in ("at", "score", "seed_at", "seed")), strict=True) if found is not None else ():
            known[at] = max(known.get(at, (-math.inf,)), tuple(x))
        m = matrix(forms["vector"])
        u, ats, names = units(m), forms["at"].to_pylist(), forms["form"].to_pylist()
        taken, joined = _Seeds(m, u), list(names)
        for lo in range(0, len(m), ROWS):
            part, before = u[lo : lo + ROWS], len(taken.of)
            far, near = part @ taken.rows[:before].T, part @ part.T
            tops = far.max(axis=1, initial=-math.inf)
            for i in range(len(part)):
                best, seed = known[ats[lo + i]][::2] if ats[lo + i] in known else (threshold, None)
                new = near[i, [k - lo for k in taken.of[before:]]]
                top = max(tops[i], new.max(initial=-math.inf))
                if top >= best - SLACK:
                    v, floor = m[lo + i].tolist(), max(top, best) - SLACK
                    for k in [*np.nonzero(far[i] >= floor)[0], *(before + np.nonzero(new >= floor)[0])]:
                        if (score := taken.score(k, v, size_of(v))) >= best:
                            best, seed = score, names[taken.of[k]]
                if seed is None:
                    taken.add(lo + i)
                else:
                    joined[lo + i] = seed
        own = np.zeros(len(m), dtype=bool)
        own[taken.of] = True
        lists = pc.if_else(pa.array(own), forms["vector"].combine_chunks(), pa.scalar(None, forms["vector"].type)) if len(m) else forms["vector"]
        return pa.table([forms["entity_type"], forms["form"], pa.array(joined, pa.string()), forms["at"], lists], names=["entity_type", "form", "seed", "at", "vector"])

    return run


def settle_first(threshold: float) -> Callable[[pa.Table], pa.Table]:
    """As :func:`settle` where no seeds are before the block."""
    run = settle(threshold)
    return lambda forms: run(forms, None)


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of rows, summed in order as the column expression does."""
    with np.errstate(all="ignore"):
        dot, aa, bb = (np.add.accumulate(x, axis=1)[:, -1] if a.shape[1] else np.zeros(len(a)) for x in (a * b, a * a, b * b))
        n = np.sqrt(aa) * np.sqrt(bb)
        return np.where(n == 0, 0.0, dot / n)


def _best_pairs(a: np.ndarray, b: np.ndarray, seq: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row of ``a`` the k rows of ``b`` of the greatest (score, -seq): indices of both, and the score. NaN is greatest."""
    ua, ub, out = units(a), units(b), []
    with np.errstate(all="ignore"):
        odd_a, odd_b = (~np.isfinite((x * x).sum(axis=1)) for x in (a, b))  # no product says what these score
    for lo in range(0, len(a), ROWS):
        near = ua[lo : lo + ROWS] @ ub.T
        near[odd_a[lo : lo + ROWS]] = near[:, odd_b] = np.inf
        floor = near.max(axis=1) if k == 1 else np.partition(near, -min(k, len(b)), axis=1)[:, -min(k, len(b))]
        i, j = np.nonzero(near >= np.where(np.isinf(floor), -np.inf, floor - SLACK)[:, None])
        score = np.concatenate([scores(a[lo + i[s : s + BLOCK]], b[j[s : s + BLOCK]]) for s in range(0, len(i), BLOCK)])
        order = np.lexsort((seq[j], -np.where(np.isnan(score), np.inf, score), i))
        first = np.searchsorted(i[order], i[order], side="left")
        order = order[np.arange(len(order)) - first < k]
        out.append((lo + i[order], j[order], score[order]))
    return tuple(map(np.concatenate, zip(*out, strict=True)))


def nearest_by_type(mentions: DataFrame, entities: DataFrame, k: int, block: int = BLOCK, counted: DataFrame | None = None) -> DataFrame:
    """Mentions (mention_id, entity_type, vector) with entities of their type (embedding, insert_seq) and the score: the k
    nearest at least, ties in insertion order, for the k nearest of each block of entities are among these rows.
    ``counted`` holds the mentions, and perhaps others, where counting it costs less."""
    m, e = mentions.where("entity_type is not null and vector is not null"), entities.where("entity_type is not null and embedding is not null")
    asked, some = (max(1, -(-x.count() // block)) for x in (mentions if counted is None else counted, entities))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    columns, more = m.columns, [c for c in entities.columns if c != "entity_type"]
    schema = T.StructType([*m.schema.fields, *[e.schema[c] for c in more], T.StructField("score", T.DoubleType())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        i = j = np.zeros(0, dtype=np.int64)
        score = np.zeros(0)
        if len(left) and len(right):
            a, b = matrix(left["vector"]), matrix(right["embedding"])
            if a.shape[1] != b.shape[1]:
                raise ValueError("vectors differ in size")
            i, j, score = _best_pairs(a, b, pc.rank(right["insert_seq"], tiebreaker="dense").to_numpy().astype(np.int64), k)
        left, right = left.select(columns).take(i), right.select(more).take(j)
        return pa.table([*left.columns, *right.columns, pa.array(score)], names=[*columns, *more, "score"])

    keys = ["entity_type", "_asked", "_some"]
    dealt = m.withColumn("_asked", part("mention_id", asked)).withColumn("_some", every(some)).groupBy(*keys)
    return dealt.cogroup(e.withColumn("_some", part("insert_seq", some)).withColumn("_asked", every(asked)).groupBy(*keys)).applyInArrow(run, schema)
