"""Connected components and candidate links, distributed: nothing about single documents reaches the driver but counts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MembershipFilter, materialize, mix64, release, slices

#: Characters or shingles of payloads that are handled at once; a shingle takes eight bytes in several arrays.
PART = 1 << 18
#: A further pivot pays while one in so many of its pairs is a link.
JOINS_OF_PIVOT = 10
#: Sets that hold a shingle, at most, for a task to form its pairs in memory.
HELD_BY = 2048
#: Band keys or shingles that a task sorts at once, and about as many in a range of them.
RANGE_KEYS = 1 << 20
#: Members of a bucket, at most, for a task to hold the sketches of all its pairs against each other.
PAIRED = 1024
#: Bits of a sketch at least and, of large sets, at most; a longer one rules out more pairs, a shorter one is no less exact.
SKETCH_BITS = 256
SKETCH_MOST = 1 << 16


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every node of ``links`` (a, b): component is the smallest node it reaches.

    Distributed union-find: every node hooks to its smallest smaller neighbour, chains are halved by pointer jumping, and
    links are contracted to the roots, until none is left. Self links only name their node.
    """
    cur = materialize(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    labels = cur.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("component", F.col("id"))
    while not cur.where("a < b").isEmpty():
        parent = materialize(cur.where("a < b").groupBy(F.col("b").alias("id")).agg(F.min("a").alias("root")), "parents")
        while True:
            up = parent.select(F.col("id").alias("root"), F.col("root").alias("next"))
            jumped = materialize(parent.join(up, "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "parents")
            parent = jumped.select("id", "root")
            if jumped.where("moved").isEmpty():
                break

        def rooted(frame: DataFrame, column: str, parent: DataFrame = parent) -> DataFrame:
            up = parent.select(F.col("id").alias(column), "root")
            return frame.join(up, column, "left").withColumn(column, F.coalesce("root", column)).drop("root")

        labels = materialize(rooted(labels, "component").select("id", "component"), "labels")
        cur = rooted(rooted(cur, "a"), "b").where("a <> b")
        cur = materialize(cur.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    return labels


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` after ``links`` between nodes, found later."""
    of = labels.select(F.col("id").alias("a"), F.col("component").alias("ca"))
    ends = links.join(of, "a", "left").join(of.select(F.col("a").alias("b"), F.col("ca").alias("cb")), "b", "left")
    found = ends.select("a", "b", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb"))
    over = components(found.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    nodes = labels.unionByName(found.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(labels, "id", "left_anti").withColumn("component", F.col("id")))
    over = over.select(F.col("id").alias("component"), F.col("component").alias("root"))
    return materialize(nodes.join(over, "component", "left").select("id", F.coalesce("root", "component").alias("component")), "labels")


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A stable order that sorts 64-bit words, and where each distinct one begins in it."""
    low = np.uint64((1 << max(1, len(values).bit_length())) - 1)
    # words whose low bits give way to their place sort much faster than by index; almost never do the low bits matter
    order = (np.sort(values & ~low | np.arange(len(values), dtype=np.uint64)) & low).astype(np.int64)
    ranked = values[order]
    if (ranked[1:] < ranked[:-1]).any():
        order = np.argsort(values, kind="stable")
        ranked = values[order]
    return order, np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])[: len(values)]


def _cuts(values: np.ndarray, ranges: int) -> np.ndarray:
    """Where each of ``ranges`` equal ranges of 64-bit words begins in sorted ``values``."""
    return np.searchsorted((values >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32), np.arange(ranges + 1))


def _planes(x: np.ndarray) -> bytes:
    """The first bytes of all words, then the second ones, and so on: what they have in common, shuffles then compress."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def _words(raw: bytes, kind: str) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _steps(x: np.ndarray) -> bytes:
    """Ascending words by their differences."""
    return _planes(np.diff(x, prepend=x.dtype.type(0)))


def _climbed(raw: bytes, kind: str) -> np.ndarray:
    return np.cumsum(_words(raw, kind), dtype=kind)


def _blob(column: pa.ChunkedArray, kind: str, read: Callable[[bytes, str], np.ndarray] = _words) -> list[np.ndarray]:
    return [read(x, kind) for x in column.to_pylist()]


def _prefix_pairs(sets: DataFrame, shingles: Callable[[pa.Array], list[np.ndarray]], percent: int) -> DataFrame:
    """Pairs (a, b) across components that can reach the similarity, of sets (id, component, stray, payload), one stray at least.

    Sets with Jaccard similarity t share a shingle among the first n - ceil(t n) + 1 of each, in any order common to all.
    Here shingles that no other component holds come first: they propose nothing, and a set with too many of them has no
    partner at all. The others follow by how many sets hold them, counted exactly: blocks of sets send their distinct
    shingles, each once, in packed arrays to ranges of shingles, which send the counts back. A shingle that a third of all
    sets hold is one entry a block.
    """
    measure = F.length if sets.schema["payload"].dataType.simpleString() == "string" else F.size
    total = sets.agg(F.sum(measure("payload"))).first()[0] or 0
    n = max(1, -(-total // RANGE_KEYS))
    blocks = sets.select("id", "component", "stray", "payload", F.expr(f"cast(pmod(xxhash64(id), {n}) as int)").alias("block"))

    def shingles_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        found = [s for batch in slices(table.select(["payload"]).to_batches(), "payload", PART) for s in shingles(batch.column(0))]
        return np.concatenate(found).view(np.uint64), np.array([len(s) for s in found], np.int64)

    def count(table: pa.Table) -> pa.Table:
        flat, sizes = shingles_of(table)
        order, heads = _distinct(flat)
        component = np.repeat(table["component"].to_numpy(), sizes)[order]
        lo, hi = np.minimum.reduceat(component, heads), np.maximum.reduceat(component, heads)
        values, held = flat[order[heads]], np.diff(np.r_[heads, len(flat)])
        cuts, rows = _cuts(values, n), []
        for k in np.flatnonzero(np.diff(cuts)).tolist():
            part = slice(cuts[k], cuts[k + 1])
            wide = np.flatnonzero(lo[part] < hi[part]).astype("<u4")
            rows.append((k, table["block"][0].as_py(), _steps(values[part]), _planes(held[part].astype("<u4")), _planes(lo[part]), _steps(wide)))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["range", "block", "shingles", "held", "component", "wide"])

    def add(table: pa.Table) -> pa.Table:
        values, held, lo = _blob(table["shingles"], "<u8", _climbed), _blob(table["held"], "<u4"), _blob(table["component"], "<i8")
        spread = [np.zeros(len(v), bool) for v in values]
        for s, wide in zip(spread, _blob(table["wide"], "<u4", _climbed), strict=True):
            s[wide] = True
        flat, component = np.concatenate(values), np.concatenate(lo)
        order, heads = _distinct(flat)
        across = np.logical_or.reduceat(np.concatenate(spread)[order], heads) | (np.minimum.reduceat(component[order], heads) < np.maximum.reduceat(component[order], heads))
        holders = np.where(across, np.add.reduceat(np.concatenate(held).astype(np.int64)[order], heads), 0)
        back = np.empty(len(flat), "<i8")
        back[order] = np.repeat(holders, np.diff(np.r_[heads, len(flat)]))
        parts = np.split(back, np.cumsum([len(v) for v in values])[:-1])
        return pa.table({"block": table["block"], "range": table["range"], "holders": pa.array([_planes(x) for x in parts], pa.binary())})

    def prefixes(table: pa.Table, counted: pa.Table) -> pa.Table:
        flat, sizes = shingles_of(table)
        order, heads = _distinct(flat)
        holders = np.empty(len(flat), np.int64)
        holders[order] = np.repeat(np.concatenate(_blob(counted.sort_by("range")["holders"], "<i8")), np.diff(np.r_[heads, len(flat)]))
        each = np.repeat(np.arange(len(sizes)), sizes)
        order = np.lexsort((flat.view(np.int64), holders, each))  # signed, as Spark orders them below
        place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        first = (place < sizes[each] - -(-percent * sizes[each] // 100) + 1) & (holders[order] > 0)
        kept = np.bincount(each[first], minlength=len(sizes))
        each, at = pa.array(each[first]), order[first]
        taken = [table[c].take(each) for c in ("id", "component", "stray")]
        return pa.table([*taken, pa.array(flat[at].view(np.int64)), pa.array(holders[at]), pa.array(place[first]), pa.array(sizes).take(each), pa.array(kept).take(each)], names=["id", "component", "stray", "shingle", "holders", "place", "n", "kept"])

    kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 4]
    sent = blocks.groupBy("block").applyInArrow(count, "range int, block int, shingles binary, held binary, component binary, wide binary")
    counted = sent.groupBy("range").applyInArrow(add, "block int, range int, holders binary")
    first = blocks.groupBy("block").cogroup(counted.groupBy("block")).applyInArrow(prefixes, "id bigint, component bigint, stray boolean, shingle bigint, holders bigint, place bigint, n bigint, kept bigint")
    first = materialize(first, "prefixes")
    # shingles that the very same sets hold propose the same pairs: the first of them in the order is enough, as it is
    # also the first that any two of these sets have in common
    held = first.groupBy("shingle").agg(F.min("holders").alias("holders"), F.min("id").alias("least"), F.count(F.lit(1)).alias("m"), F.bit_xor(F.xxhash64("id")).alias("of"), F.min("component").alias("lo"), F.max("component").alias("hi"), F.max("stray").alias("any"))
    chosen = held.where("any and lo <> hi").groupBy("least", "m", "of").agg(F.min(F.struct("holders", "shingle")).alias("s"), F.count(F.lit(1)).alias("weight")).select("s.shingle", "m", "weight")
    ranged = F.expr(f"cast(shiftrightunsigned(shingle, 32) * {n} div 4294967296 as int)")
    first = materialize(first.drop("holders").join(chosen, "shingle").withColumn("range", ranged), "first-shingles")

    # sets share what both prefixes hold, and at most the rest of the one that ends first: so much must be in both prefixes
    rest_of = lambda n: -(-percent * n // 100) - 1

    def propose(table: pa.Table) -> pa.Table:
        """The pairs of a range of shingles, each once, with how many shingles of the range both prefixes and each of them hold.

        Left out are pairs that could not share enough if all else in their prefixes were common, and those that could not
        if their first common shingle here were the first of all: the range that holds that one proposes them.
        """
        ids, at, who = np.unique(table["id"].to_numpy(), return_index=True, return_inverse=True)
        component, place, size, stray, weight = (table[c].to_numpy() for c in ("component", "place", "n", "stray", "weight"))
        n_of, kept, inside = size[at], table["kept"].to_numpy()[at], np.bincount(who, weight, len(ids)).astype(np.int64)
        order, heads = _distinct(table["shingle"].to_numpy().view(np.uint64))
        many, found, held = np.diff(np.r_[heads, len(order)]), [(np.zeros(0, np.int64),) * 3], 0

        def sums(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
            codes, *counts = (np.concatenate(x) for x in zip(*parts, strict=True))
            codes, place = np.unique(codes, return_inverse=True)
            return codes, *(np.bincount(place, x, len(codes)).astype(np.int64) for x in counts)

        for m in np.unique(many[many > 1]).tolist():
            i, j = np.triu_indices(m, 1)
            begins = heads[many == m]
            step = max(1, (RANGE_KEYS >> 3) // len(i))
            for lo in range(0, len(begins), step):
                rows = order[begins[lo : lo + step, None] + np.arange(m)]
                x, y = rows[:, i].ravel(), rows[:, j].ravel()
                near = (component[x] != component[y]) & (stray[x] | stray[y])
                near &= (100 + percent) * np.minimum(size[x], size[y]) >= percent * (size[x] + size[y])
                x, y = x[near], y[near]
                reach = (100 + percent) * np.minimum(size[x] - place[x], size[y] - place[y]) >= percent * (size[x] + size[y])
                w, x, y = weight[x], who[x], who[y]
                found.append(sums([(np.minimum(x, y) * len(ids) + np.maximum(x, y), w, reach)]))
                held += len(found[-1][0])
                if held > RANGE_KEYS:
                    found, held = [sums(found)], 0
        codes, both, reach = sums(found)
        x, y = codes // len(ids), codes % len(ids)
        need = -(-percent * (n_of[x] + n_of[y]) // (100 + percent)) - np.maximum(rest_of(n_of[x]), rest_of(n_of[y]))
        fine = (reach > 0) & (both + np.minimum(kept[x] - inside[x], kept[y] - inside[y]) >= need)
        x, y = x[fine], y[fine]
        return pa.table([pa.array(c) for c in (ids[x], ids[y], both[fine], need[fine], inside[x], inside[y], kept[x], kept[y])], names=names)

    names = ["a", "b", "both", "need", "inside_a", "inside_b", "kept_a", "kept_b"]
    proposed = first.where(F.col("m") <= HELD_BY).groupBy("range").applyInArrow(propose, ", ".join(f"{c} bigint" for c in names))
    # shingles of more sets are left to a join, which Spark splits where one makes too many rows
    often = first.where(F.col("m") > HELD_BY)
    x = often.where("stray").select("shingle", "weight", *[F.col(c).alias(f"{c}_x") for c in ("id", "component", "n", "kept")])
    y = often.select("shingle", *[F.col(c).alias(f"{c}_y") for c in ("id", "component", "stray", "n", "kept")])
    # two strays meet once
    once = ~F.col("stray_y") | (F.col("id_x") < F.col("id_y"))
    length = (100 + percent) * F.least("n_x", "n_y") >= percent * (F.col("n_x") + F.col("n_y"))
    met = x.join(y, "shingle").where((F.col("component_x") != F.col("component_y")) & once & length)
    need = F.expr(f"({percent} * (n_x + n_y) + {99 + percent}) div {100 + percent} - (({percent} * greatest(n_x, n_y) + 99) div 100 - 1)")
    ends = F.col("id_x") < F.col("id_y")
    kept = [F.when(ends, F.col(c)).otherwise(F.col(d)) for c, d in (("kept_x", "kept_y"), ("kept_y", "kept_x"))]
    weight = F.col("weight")
    met = met.select(*[c.alias(n) for c, n in zip([F.least("id_x", "id_y"), F.greatest("id_x", "id_y"), weight, need, weight, weight, *kept], names, strict=True)])
    # ranges that did not propose a pair may hold all else of its prefixes in common
    sums = [F.sum(c).alias(c) for c in ("both", "inside_a", "inside_b")] + [F.max(c).alias(c) for c in ("need", "kept_a", "kept_b")]
    pairs = proposed.unionByName(met).groupBy("a", "b").agg(*sums)
    return pairs.where("both + least(kept_a - inside_a, kept_b - inside_b) >= need").select("a", "b")


def _sketches(column: pa.Array, shingles: Callable[[pa.Array], list[np.ndarray]]) -> tuple[np.ndarray, list[bytes]]:
    """The sizes of the sets of a column, and for each set the parities of how many of its shingles fall on each place of its sketch.

    The places are a power of two: ``SKETCH_BITS`` at least, and no fewer than the shingles up to ``SKETCH_MOST``.
    """
    found = shingles(column)
    sizes = np.array([len(s) for s in found], np.int64)
    width = np.minimum(np.maximum(SKETCH_BITS, 2 ** np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64)), max(SKETCH_BITS, SKETCH_MOST))
    ends = np.cumsum(width)
    place = np.repeat(ends - width, sizes) + (np.concatenate(found).view(np.uint64) % np.repeat(width, sizes).astype(np.uint64)).astype(np.int64)
    odd = np.packbits(np.bincount(place, minlength=int(ends[-1])).astype(np.uint8) & 1).tobytes()
    return sizes, [odd[(e - w) // 8 : e // 8] for e, w in zip(ends.tolist(), width.tolist(), strict=True)]


def _forest(u: np.ndarray, v: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The places of a forest of the lightest edges that spans what the edges (u, v) between nodes 0, 1, ... join."""
    left, chosen = np.argsort(weight, kind="stable"), [np.zeros(0, np.int64)]
    root = np.arange(int(max(u.max(initial=-1), v.max(initial=-1))) + 1)
    while True:
        left = left[root[u[left]] != root[v[left]]]
        if not len(left):
            return np.concatenate(chosen)
        a, b, last = root[u[left]], root[v[left]], len(left)
        best = np.full((2, len(root)), last)
        for row, x in zip(best, (a, b), strict=True):
            row[x[::-1]] = np.arange(last)[::-1]
        best = best.min(axis=0)
        own = np.flatnonzero(best < last)
        edge = best[own]
        chosen.append(left[np.unique(edge)])
        up = np.arange(len(root))
        up[own] = a[edge] + b[edge] - own
        both = own[up[up[own]] == own]
        up[both] = np.minimum(both, up[both])
        while (up[up] != up).any():
            up = up[up]
        root = up[root]


def _sketched_pairs(members: DataFrame, data: DataFrame, shingles: Callable[[pa.Array], list[np.ndarray]], percent: int, passes: MembershipFilter | None = None, forest: bool = False) -> DataFrame:
    """Pairs (a, b) across components within each bucket of ``members`` (key, id, component) whose sketches leave a link possible.

    Only shingles that one set of two has make their sketches differ, each at one place: where these differ at more places
    than sets of that similarity have shingles apart, the pair is no link. So no link is lost, and no text is moved.
    ``passes`` lets the members' rows of ``data`` through; it is asked where the sketches are made, as each Python step of
    a task is a process of its own, which then stays beside the others.

    With ``forest``, rows (a, b, key): of the pairs of a range of buckets only the likeliest that join all components which
    its pairs can join (key is null), and the members (a, of bucket key, b is null) that have further pairs. So the rows
    grow with the members, not with their pairs; a second call settles what the first one's links leave open.
    """
    ranges = max(1, members.count() >> 13)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = batches if passes is None else (batch.filter(pa.array(passes(batch.column(0).to_numpy()))) for batch in batches)
        for batch in slices(wanted, "payload", PART):
            sizes, bits = _sketches(batch.column(1), shingles)
            yield pa.record_batch({"id": batch.column(0), "n": pa.array(sizes), "sketch": pa.array(bits, pa.binary())})
        release()

    def propose(table: pa.Table) -> pa.Table:
        table = table.sort_by("key")
        key, ids, component, n = (table[c].to_numpy() for c in ("key", "id", "component", "n"))
        raw = table["sketch"].to_pylist()
        width = np.array([len(x) for x in raw], np.int64)
        folded: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def sketches(of: int) -> tuple[np.ndarray, np.ndarray]:
            """Where each member stands in, and the sketches at ``of`` bytes: those of a wider one are the parities of its parts."""
            if of not in folded:
                at, parts, have = np.zeros(len(raw), np.int64), [], 0
                for w in np.unique(width[width >= of]).tolist():
                    rows = np.flatnonzero(width == w)
                    at[rows], have = np.arange(have, have + len(rows)), have + len(rows)
                    bits = np.frombuffer(b"".join(raw[i] for i in rows), "<u8").reshape(len(rows), w // of, -1)
                    parts.append(np.bitwise_xor.reduce(bits, axis=1))
                folded[of] = at, np.concatenate(parts)
            return folded[of]

        heads = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        many, found = np.diff(np.r_[heads, len(key)]), [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for m in np.unique(many[many > 1]).tolist():
            i, j = np.triu_indices(m, 1)
            begins = heads[many == m]
            step = max(1, (RANGE_KEYS >> 4) // len(i))
            for lo in range(0, len(begins), step):
                rows = begins[lo : lo + step, None] + np.arange(m)
                x, y = rows[:, i].ravel(), rows[:, j].ravel()
                near = component[x] != component[y]
                near[near] = (100 + percent) * np.abs(n[x[near]] - n[y[near]]) <= (100 - percent) * (n[x[near]] + n[y[near]])
                x, y = x[near], y[near]
                narrow = np.minimum(width[x], width[y])
                for of in np.unique(narrow).tolist():
                    at, bits = sketches(of)
                    p, q = x[narrow == of], y[narrow == of]
                    step_of = max(1, (RANGE_KEYS >> 4) * 64 // of)
                    for part in range(0, len(p), step_of):
                        u, v = p[part : part + step_of], q[part : part + step_of]
                        apart = np.bitwise_count(bits[at[u]] ^ bits[at[v]]).sum(axis=1, dtype=np.int64)
                        fine = (100 + percent) * apart <= (100 - percent) * (n[u] + n[v])
                        found.append((u[fine], v[fine], apart[fine] / (n[u[fine]] + n[v[fine]])))
        u, v, weight = (np.concatenate(x) for x in zip(*found, strict=True))
        if not forest:
            pairs = np.unique(np.sort(np.stack([ids[u], ids[v]], axis=1), axis=1), axis=0)
            return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})
        names, node = np.unique(component, return_inverse=True)
        taken = _forest(node[u], node[v], weight)
        more = np.ones(len(u), bool)
        more[taken] = False
        more = np.unique(np.concatenate([u[more], v[more]]))
        a, b = np.minimum(ids[u[taken]], ids[v[taken]]), np.maximum(ids[u[taken]], ids[v[taken]])
        nothing = [pa.nulls(k, pa.int64()) for k in (len(more), len(taken))]
        return pa.table({"a": pa.array(np.r_[a, ids[more]]), "b": pa.chunked_array([pa.array(b), nothing[0]]), "key": pa.chunked_array([nothing[1], pa.array(key[more])])})

    sketched = data.select("id", "payload").mapInArrow(sketch, "id bigint, n bigint, sketch binary")
    met = members.select("key", "id", "component").join(sketched, "id").withColumn("range", F.expr(f"cast(pmod(xxhash64(key), {ranges}) as int)"))
    return met.groupBy("range").applyInArrow(propose, "a bigint, b bigint, key bigint" if forest else "a bigint, b bigint").distinct()


def _band_keys(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The keys of a column of packed bands in one array, and their number in each row."""
    sizes = np.asarray(pa.compute.binary_length(column)) // 8
    return np.frombuffer(b"".join(column.to_pylist()), "<i8"), sizes


def shared_buckets(bands: DataFrame, n_keys: int) -> DataFrame:
    """(key, pivot, n, of) of the band keys that several nodes of ``bands`` (id bigint, bands binary: 64-bit words) have.

    pivot is the smallest node, n their number and ``of`` a digest of who they are. A task sorts its keys and sends one
    entry for each, in packed arrays, so a key that a third of all nodes have is one entry a task; ``n_keys``, the number
    of keys at most, sets how many ranges of keys they are dealt into.
    """
    ranges = max(1, -(-n_keys // RANGE_KEYS))

    def packed(keys: np.ndarray, ids: np.ndarray, n: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, ...]:
        order, heads = _distinct(keys)
        return keys[order[heads]], np.minimum.reduceat(ids[order], heads), np.add.reduceat(n[order], heads), np.bitwise_xor.reduceat(of[order], heads)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def entries() -> pa.RecordBatch:
            keys, ids = (np.concatenate(x) for x in zip(*held, strict=True))
            keys, ids, n, of = packed(keys, ids, np.ones(len(keys), np.int64), mix64(ids))
            cuts = _cuts(keys, ranges)
            base = int(ids.min())
            narrow = int(ids.max()) - base < 1 << 32
            rows = []
            for k in np.flatnonzero(np.diff(cuts)).tolist():
                part = slice(cuts[k], cuts[k + 1])
                many = np.flatnonzero(n[part] > 1).astype("<u4")
                pivots = (ids[part] - base).astype("<u4") if narrow else ids[part]
                rows.append((k, base if narrow else None, _steps(keys[part]), _planes(pivots), _steps(many), _planes(n[part][many]), _planes(of[part][many])))
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            keys, sizes = _band_keys(batch.column(1))
            held.append((keys.view(np.uint64), np.repeat(batch.column(0).to_numpy(), sizes)))
            if sum(len(k) for k, _ in held) >= RANGE_KEYS:
                yield entries()
                held.clear()
        if sum(len(k) for k, _ in held):
            yield entries()
        held.clear()
        release()

    def combine(table: pa.Table) -> pa.Table:
        parts = []
        for _, base, *raw in zip(*(c.to_pylist() for c in table.columns), strict=True):
            keys = _climbed(raw[0], "<u8")
            ids = _words(raw[1], "<i8") if base is None else _words(raw[1], "<u4").astype(np.int64) + base
            n, of, many = np.ones(len(keys), np.int64), mix64(ids), _climbed(raw[2], "<u4")
            n[many], of[many] = _words(raw[3], "<i8"), _words(raw[4], "<u8")
            parts.append((keys, ids, n, of))
        keys, ids, n, of = packed(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        at = np.flatnonzero(n > 1)
        return pa.table({"key": keys[at].view(np.int64), "pivot": ids[at], "n": n[at], "of": of[at].view(np.int64)})

    names = ["range", "base", "keys", "pivots", "many", "n", "of"]
    kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 5]
    dealt = bands.select("id", "bands").mapInArrow(deal, "range int, base bigint, keys binary, pivots binary, many binary, n binary, of binary")
    return dealt.groupBy("range").applyInArrow(combine, "key bigint, pivot bigint, n bigint, of bigint")


def link_components(
    bands: DataFrame, payload: Callable[[DataFrame], DataFrame], agree: Callable[[DataFrame], DataFrame], shingles: Callable[[pa.Array], list[np.ndarray]], percent: int, *, n_keys: int, equal: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """(id, component) of the nodes that verified links join, given ``bands`` (id bigint, bands binary: 64-bit words).

    Nodes that share a band key are in one bucket. The components are those of the graph of *all* pairs within buckets
    that ``agree`` confirms, without looking at all of them: first every member meets the bucket's smallest one, after
    which all pairs of that one are settled; where the others still lie in several components they meet the smallest of
    these, and so on while one pair in ``JOINS_OF_PIVOT`` is a link; for what is then left in several components, pairs
    across them are proposed by their rarest shingles (`_prefix_pairs`), which loses none. Buckets of ``PAIRED`` members at
    most need none of this after the first pivot: all their pairs across components meet by sketches (`_sketched_pairs`).

    ``payload(ids)`` gives (id, payload); ``agree`` filters (a, b, x, y), x and y the payloads of a and b, to the links,
    which must be the pairs whose ``shingles`` (distinct, as 64-bit words) have a Jaccard similarity of ``percent`` at least.
    ``n_keys`` is the number of band keys, or more. ``equal(ids)`` gives (id, rep) of nodes known to equal a smaller one.
    """
    found = shared_buckets(bands, n_keys)
    # many bands have the very same members: one of them is enough
    shared = materialize(found.groupBy("pivot", "n", "of").agg(F.min("key").alias("key")), "buckets")
    n = shared.count()
    if not n:
        return bands.select("id", F.col("id").alias("component")).where("false")
    passes = MembershipFilter(shared.select("key"), n)

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, sizes = _band_keys(batch.column(1))
            hit = passes(flat)
            yield pa.record_batch({"id": np.repeat(batch.column(0).to_numpy(), sizes)[hit], "key": flat[hit]})

    members = bands.select("id", "bands").mapInArrow(passing, "id bigint, key bigint").join(shared.select("key", "pivot"), "key").where("id <> pivot")
    members = materialize(members.select("key", "id", "pivot"), "members")
    copies = None
    if equal is not None:
        copies = equal(members.select("id").union(members.select("pivot")).distinct())
        members = members.join(copies, "id", "left").select("key", F.coalesce("rep", "id").alias("id"), "pivot").where("id <> pivot").distinct()
        members = materialize(members, "members")
    stars = materialize(members.select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct(), "stars")
    data = materialize(payload(stars.select(F.explode(F.array("a", "b")).alias("id")).distinct()), "payload")

    def payload_of(ids: DataFrame, n: int) -> DataFrame:
        """Payloads that may be those of ``ids``: the others stay out of the shuffle."""
        passes = MembershipFilter(ids, n)

        @F.pandas_udf("boolean")
        def maybe(column: pd.Series) -> pd.Series:
            return pd.Series(passes(column.to_numpy()))

        return data.where(maybe("id"))

    def verified(pairs: DataFrame) -> DataFrame:
        n = pairs.count()
        x = payload_of(pairs.select("a"), n).select(F.col("id").alias("a"), F.col("payload").alias("x"))
        y = payload_of(pairs.select("b"), n).select(F.col("id").alias("b"), F.col("payload").alias("y"))
        # the pivot comes last: the rows of one that many meet then have the size by which Spark splits a skewed join
        return materialize(agree(pairs.join(y, "b").join(x, "a").select("a", "b", "x", "y")).select("a", "b"), "links")

    # one pivot joins most members of a group; the others are asked only where they stand apart
    first = materialize(stars.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "pairs")
    labels = components(verified(first))
    of = labels.select(F.col("id").alias("a"), F.col("component").alias("ca"))
    apart = stars.join(of, "a", "left").join(of.select(F.col("a").alias("b"), F.col("ca").alias("cb")), "b", "left").where("coalesce(ca, a) <> coalesce(cb, b)").select("a", "b")
    rest = materialize(apart.join(first, ["a", "b"], "left_anti"), "pairs")
    if not rest.isEmpty():
        labels = merged(labels, verified(rest))
    tried, going, paired = first.unionByName(rest), True, False
    while True:
        # all pairs of the pivots are settled; where the others lie in several components they get another pivot, as long
        # as that joins many of them: the first one may be unlike the rest of a large group
        placed = members.where("id <> pivot").select("key", "id").join(labels, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
        parts = placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"), F.bit_xor(F.xxhash64("id")).alias("of"))
        of_key = [F.max_by("component", F.struct("n", "component")).alias("largest"), F.min(F.struct("least", "component")).alias("p"), F.count(F.lit(1)).alias("parts"), F.sum("n").alias("size"), F.bit_xor("of").alias("of")]
        several = parts.groupBy("key").agg(*of_key).where("parts > 1")
        # buckets that are left with the very same members: one of them is enough
        several = several.groupBy("size", "of", "p", "largest").agg(F.min("key").alias("key")).select("key", "largest", F.col("p.least").alias("pivot"), F.col("p.component").alias("pivot_component"), "size")
        members = materialize(placed.join(several, "key"), "members")
        if not paired:
            few, members, paired = members.where(F.col("size") <= PAIRED), members.where(F.col("size") > PAIRED), True
            ids = materialize(few.select("id").distinct(), "open")
            n = ids.count()
            if n:
                # first the likeliest pairs that could join all, then those that still lie across components
                likely = materialize(_sketched_pairs(few, data, shingles, percent, MembershipFilter(ids, n), forest=True), "likely")
                pairs = materialize(likely.where("b is not null").select("a", "b").distinct(), "pairs")
                if not pairs.isEmpty():
                    labels = merged(labels, verified(pairs))
                still = likely.where("b is null").select("key", F.col("a").alias("id")).join(labels, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
                across = still.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
                still = materialize(still.join(across, "key"), "members")
                ids = materialize(still.select("id").distinct(), "open")
                n = ids.count()
                if n:
                    more = _sketched_pairs(still, data, shingles, percent, MembershipFilter(ids, n))
                    pairs = materialize(more.join(pairs, ["a", "b"], "left_anti"), "pairs")
                    if not pairs.isEmpty():
                        labels = merged(labels, verified(pairs))
        if not going or members.isEmpty():
            break
        rest = members.where("component <> pivot_component").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct()
        rest = materialize(rest.join(tried, ["a", "b"], "left_anti"), "pairs")
        found = verified(rest)
        going = JOINS_OF_PIVOT * found.count() >= rest.count() > 0
        labels, tried = merged(labels, found), tried.unionByName(rest)
    # of two members in different components one at least is outside the bucket's largest component
    open_ids = members.groupBy("id", "component").agg(F.max(F.col("component") != F.col("largest")).alias("stray"))
    open_ids = materialize(open_ids, "open")
    if not open_ids.isEmpty():
        pairs = materialize(_prefix_pairs(open_ids.join(data, "id"), shingles, percent), "pairs")
        if not pairs.isEmpty():
            labels = merged(labels, verified(pairs))
    if copies is None:
        return labels
    of = labels.select(F.col("id").alias("rep"), "component")
    return labels.unionByName(copies.join(of, "rep", "left").select("id", F.coalesce("component", "rep").alias("component")))
