"""Exact cosine links of embeddings by a dual traversal of cover trees.

Unit vectors at cosine c are sqrt(2 - 2c) apart, so a cosine threshold is a distance t. Equal vectors of a label are one
class with a multiplicity. A label of more classes than a task should hold is cut into cells around centres of a sample,
and cells into blocks. A task gets two blocks, builds a cover tree over each (nested levels whose radii halve, down to
single points) and traverses the two together: a pair of nodes is dropped when its balls are too far apart, taken whole
when they are near enough throughout, else opened.

A vector is sent to meet another cell only where a partner can be: within t of that cell's ball, and no farther from its
centre than from the own one by more than 2t. Where vectors lie in clusters this keeps them at home; where they point
everywhere, no bound of distances keeps any two cells apart, and the work is the square of a label's classes.

A task emits one row per class it found links for (their number, and the smallest class of its part), never the pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .links import components

#: Classes of a block and bytes of its vectors, at most; points of a leaf; points that meet all centres of a level at once.
BLOCK, BLOCK_BYTES, LEAF, CHUNK = 16_384, 16 << 20, 24, 512
#: Vectors that the centres of all large labels come from, about, and sampled vectors to a centre.
SAMPLE, SAMPLED = 32_768, 16
#: Rounding of distances that bounds must leave room for.
SLACK = 1e-6


def unit(rows: np.ndarray) -> np.ndarray:
    scaled = rows / np.abs(rows).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * (a @ b.T)))


class Node:
    """A ball around one of its points; ``kids`` is None in a leaf. ``centres`` and ``radii`` are those of the kids."""

    __slots__ = ("centre", "centres", "kids", "points", "radii", "radius")

    def __init__(self, centre: int, radius: float, points: np.ndarray, kids: list[Node] | None):
        self.centre, self.radius, self.points, self.kids = centre, radius, points, kids
        below = kids or [self]
        self.centres, self.radii = np.array([k.centre for k in below]), np.array([k.radius for k in below])


def cover(x: np.ndarray, points: np.ndarray, radius: float) -> list[np.ndarray]:
    """Groups of points around centres (the first of each) that are more than ``radius`` apart and cover all within it."""
    centres: list[int] = []
    owner = np.empty(len(points), np.int64)
    for lo in range(0, len(points), CHUNK):
        part = points[lo : lo + CHUNK]
        left = np.arange(len(part))
        if centres:
            d = distances(x[part], x[centres])
            owner[lo : lo + len(part)] = d.argmin(axis=1)
            left = np.flatnonzero(d.min(axis=1) > radius)
        near, free = distances(x[part[left]], x[part[left]]) <= radius, np.ones(len(left), bool)
        for i in range(len(left)):
            if free[i]:
                mine = near[i] & free
                mine[i] = True
                free &= ~mine
                owner[lo + left[mine]] = len(centres)
                centres.append(int(part[left[i]]))
    order = np.argsort(owner, kind="stable")  # a centre comes before what it covers
    return np.split(points[order], np.cumsum(np.bincount(owner, minlength=len(centres)))[:-1])


def cover_tree(x: np.ndarray) -> Node:
    """The tree over unit vectors: level by level, points join a centre within half the radius of the level above."""

    def build(points: np.ndarray, radius: float) -> Node:
        centre = int(points[0])
        if len(points) == 1:
            return Node(centre, 0.0, points, None)
        reach = float(distances(x[points], x[centre][None]).max()) + SLACK
        if len(points) <= LEAF or reach <= 1e-3:
            return Node(centre, reach, points, None)
        radius = min(radius, reach) / 2
        groups = cover(x, points, radius)
        return build(groups[0], radius) if len(groups) == 1 else Node(centre, reach, points, [build(g, radius) for g in groups])

    return build(np.arange(len(x)), 2.0)


class Links:
    """Counts links and joins linked rows as a traversal reports them."""

    def __init__(self, weights: np.ndarray):
        self.weights, self.count, self.parent = weights, np.zeros(len(weights), np.int64), np.arange(len(weights))

    def root(self, i: int) -> int:
        p = self.parent
        while p[i] != i:
            p[i] = p[p[i]]
            i = int(p[i])
        return i

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def pairs(self, a: np.ndarray, b: np.ndarray) -> None:
        if not len(a):
            return
        np.add.at(self.count, a, self.weights[b])
        np.add.at(self.count, b, self.weights[a])
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        # where both are already in one part nothing is left to join
        ra, rb = self.parent[a], self.parent[b]
        for i, j in zip(a[ra != rb].tolist(), b[ra != rb].tolist(), strict=True):
            self.join(i, j)

    def all_between(self, a: np.ndarray, b: np.ndarray) -> None:
        self.count[a] += self.weights[b].sum()
        self.count[b] += self.weights[a].sum()
        for i in (*a.tolist(), *b.tolist()):
            self.join(int(a[0]), i)

    def all_within(self, a: np.ndarray) -> None:
        self.count[a] += self.weights[a].sum() - self.weights[a]
        for i in a.tolist():
            self.join(int(a[0]), i)


def dual_traversal(raw: np.ndarray, n_left: int, cosine: float, links: Links, same: bool) -> int:
    """Report all links between rows ``[:n_left]`` and the others (``same``: within all rows, each pair once).

    Returns how many pairs of nodes were dropped by their covering radii.
    """
    x = unit(raw)
    t = float(np.sqrt(2 - 2 * cosine))
    pruned = 0

    def exact(i: np.ndarray, j: np.ndarray) -> None:
        dots = np.einsum("ij,ij->i", x[i], x[j])
        hit = dots >= cosine
        for k in np.flatnonzero(np.abs(dots - cosine) < 1e-12):
            u, v = raw[i[k]], raw[j[k]]
            hit[k] = float(u @ v) / np.sqrt(float(u @ u) * float(v @ v)) >= cosine
        links.pairs(i[hit], j[hit])

    def dense(a: np.ndarray, b: np.ndarray, within: bool) -> None:
        near = distances(x[a], x[b]) <= t + SLACK
        if within:
            near &= np.tri(len(a), len(b), -1, dtype=bool).T
        i, j = np.nonzero(near)
        exact(a[i], b[j])

    def meet(a: Node, b: Node, within: bool) -> list[tuple[Node, Node]]:
        """Pairs of kids that must be opened; what can be said of the others is said."""
        nonlocal pruned
        left, right, opened = a.kids or [a], b.kids or [b], []
        for lo in range(0, len(left), CHUNK):
            d = distances(x[a.centres[lo : lo + CHUNK]], x[b.centres])
            reach = np.add.outer(a.radii[lo : lo + CHUNK], b.radii)
            mask = d <= reach + t + SLACK
            if within:  # each pair of kids once
                mask &= np.arange(len(right)) > lo + np.arange(len(d))[:, None]
                pruned += int(sum(max(0, len(right) - 1 - k) for k in range(lo, lo + len(d))) - mask.sum())
            else:
                pruned += int(mask.size - mask.sum())
            i, j = np.nonzero(mask)
            single = reach[i, j] == 0
            exact(a.centres[lo + i[single]], b.centres[j[single]])
            for p, q, whole in zip(i[~single].tolist(), j[~single].tolist(), (d + reach <= t - SLACK)[i[~single], j[~single]].tolist(), strict=True):
                if whole:
                    links.all_between(left[lo + p].points, right[q].points)
                else:
                    opened.append((left[lo + p], right[q]))
        return opened

    def cross(stack: list[tuple[Node, Node]]) -> None:
        while stack:
            a, b = stack.pop()
            if a.kids is None and b.kids is None:
                dense(a.points, b.points, False)
            else:
                stack += meet(a, b, False)

    def inner(node: Node) -> None:
        if 2 * node.radius <= t - SLACK:
            links.all_within(node.points)
        elif node.kids is None:
            dense(node.points, node.points, True)
        else:
            cross(meet(node, node, True))
            for k in node.kids:
                if len(k.points) > 1:
                    inner(k)

    if same:
        inner(cover_tree(x))
    elif 0 < n_left < len(x):
        left, right = cover_tree(x[:n_left]), cover_tree(x[n_left:])

        def shift(node: Node) -> None:
            node.points, node.centre, node.centres = node.points + n_left, node.centre + n_left, node.centres + n_left
            for k in node.kids or ():
                shift(k)

        shift(right)
        if float(distances(x[[left.centre]], x[[right.centre]])[0, 0]) <= left.radius + right.radius + t + SLACK:
            cross([(left, right)])
        else:
            pruned += 1
    return pruned


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().reshape(len(column), -1)


def _prepared(vectors: DataFrame) -> DataFrame:
    """vec_id, label, vector (double) and a digest of it; null where the vector links with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = []
            for v, label in zip(batch.column(2), batch.column(1), strict=True):
                x = v.values.to_numpy(zero_copy_only=False).astype(float) if v.is_valid and len(v.values) else np.zeros(1)
                fine = label.is_valid and np.isfinite(x).all() and x.any()
                digests.append(hashlib.blake2b((x + 0.0).tobytes(), digest_size=16).digest() if fine else None)
            yield pa.record_batch([batch.column(0), batch.column(1), batch.column(2), pa.array(digests, pa.binary())], names=["vec_id", "label", "vector", "digest"])

    kind = vectors.schema["label"].dataType.simpleString()
    return vectors.mapInArrow(run, f"vec_id bigint, label {kind}, vector array<double>, digest binary")


def _centres(x: np.ndarray) -> np.ndarray:
    """Centres by farthest points, one to ``SAMPLED`` vectors, so that the nearest of them is near."""
    x, chosen = unit(x), [0]
    d = distances(x, x[:1])[:, 0]
    while SAMPLED * len(chosen) < len(x) and d.max() > 1e-6:
        chosen.append(int(d.argmax()))
        d = np.minimum(d, distances(x, x[chosen[-1:]])[:, 0])
    return x[chosen]


def cosine_links(vectors: DataFrame, *, cosine: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", block: int = BLOCK) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept.

    Rows link when their labels are equal and not null and the cosine of their vectors, in double precision, is at least
    ``cosine``. Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, and vectors
    of different lengths do not link. Rows that repeat an identifier count each. component_id is the smallest identifier reached; a null identifier
    takes its component's, and one without links has none and is kept. Other columns are not read; an empty table gives
    no rows.
    """
    vectors = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = materialize(_prepared(vectors), "vectors")
    grouped = rows.where("digest is not null").groupBy("label", F.size("vector").alias("width"), "digest")
    classes = grouped.agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("least"), F.any_value("vector").alias("vector"))
    classes = materialize(classes.withColumn("id", F.monotonically_increasing_id()), "vector-classes")

    room = F.expr(f"least({block}, greatest(1, {BLOCK_BYTES} div (8 * width)))")
    large = classes.groupBy("label", "width").count().withColumn("room", room).where("count > room")
    # two centres to a block of classes, unless that is more than the sample for all large labels holds
    wanted = large.withColumn("wanted", F.expr(f"{2 * SAMPLED} * count / room"))
    whole = wanted.agg(F.sum("wanted")).first()[0] or 0.0
    rate = F.expr(f"cast(least(1, {min(1.0, SAMPLE / max(whole, 1.0))!r} * wanted / count) * 1000000 as bigint)")
    sampled = classes.join(wanted.select("label", "width", rate.alias("rate")), ["label", "width"]).where("pmod(xxhash64(digest), 1000000) < rate")
    sample = sampled.select("label", "width", "vector").toArrow()
    keyed: dict[tuple, list] = {}
    for label, width, vector in zip(*(c.to_pylist() for c in sample.columns), strict=True):
        keyed.setdefault((label, width), []).append(vector)
    centres = {k: _centres(np.array(v, float)) for k, v in keyed.items()}
    t = float(np.sqrt(2 - 2 * cosine))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, visits = np.zeros(batch.num_rows, np.int64), [[1]] * batch.num_rows
            keys: dict[tuple, list[int]] = {}
            for i, key in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                if key in centres:
                    keys.setdefault(key, []).append(i)
            for key, at in keys.items():
                d = distances(unit(_matrix(batch.column(3).take(pa.array(at)))), centres[key])
                cell[at] = d.argmin(axis=1)
                # a partner y of x has its centre c nearest, so d(x, c) <= t + d(y, c) <= t + d(y, own) <= 2t + d(x, own)
                bits = np.zeros((len(at), -(-d.shape[1] // 64) * 64), bool)
                bits[:, : d.shape[1]] = d <= d.min(axis=1, keepdims=True) + 2 * t + SLACK
                for i, words in zip(at, np.packbits(bits, axis=1, bitorder="little").view("<i8").tolist(), strict=True):
                    visits[i] = words
            yield pa.record_batch({"id": batch.column(0), "cell": cell, "visits": pa.array(visits, pa.list_(pa.int64()))})

    has = lambda words, cell: F.expr(f"(shiftrightunsigned({words}[cast({cell} div 64 as int)], cast({cell} % 64 as int)) & 1L) = 1L")
    placed = materialize(classes.select("id", "label", "width", "vector").mapInArrow(place, "id bigint, cell bigint, visits array<bigint>"), "placed")
    placed = classes.select("id", "label", "width").join(placed, "id")
    sizes = placed.groupBy("label", "width", "cell").agg(F.count(F.lit(1)).alias("size"))
    words = placed.select("label", "width", "cell", F.posexplode("visits").alias("at", "word")).groupBy("label", "width", "cell", "at").agg(F.bit_or("word").alias("word"))
    reach = words.groupBy("label", "width", "cell").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda s: s["word"]).alias("reach"))
    cells = sizes.join(reach, ["label", "width", "cell"]).withColumn("room", room).withColumn("blocks", F.expr("cast((size + room - 1) div room as int)")).drop("room")
    cells = materialize(cells, "cells")
    where = materialize(placed.join(cells, ["label", "width", "cell"]).select("id", "label", "width", "cell", "visits", F.expr("cast(pmod(xxhash64(id), blocks) as int)").alias("block")), "blocks")

    a = cells.select("label", "width", F.col("cell").alias("cell_a"), F.col("reach").alias("reach_a"), F.col("blocks").alias("blocks_a"))
    b = cells.select("label", "width", F.col("cell").alias("cell_b"), F.col("reach").alias("reach_b"), F.col("blocks").alias("blocks_b"))
    near = a.join(b, ["label", "width"]).where((F.col("cell_a") <= F.col("cell_b")) & has("reach_a", "cell_b") & has("reach_b", "cell_a"))
    pairs = near.withColumn("block_a", F.explode(F.expr("sequence(0, blocks_a - 1)"))).withColumn("block_b", F.explode(F.expr("sequence(if(cell_a = cell_b, block_a, 0), blocks_b - 1)")))
    pairs = materialize(pairs.select("label", "width", "cell_a", "block_a", "cell_b", "block_b").withColumn("pair", F.monotonically_increasing_id()), "block-pairs")
    one, two = ("struct(0 as side, cell_a as cell, block_a as block, cell_b as other)", "struct(1 as side, cell_b as cell, block_b as block, cell_a as other)")
    same = "cell_a = cell_b and block_a = block_b"
    sides = pairs.select("label", "width", "pair", F.expr(same).alias("same"), F.explode(F.expr(f"if({same}, array({one}), array({one}, {two}))")).alias("s"))
    sides = sides.select("label", "width", "pair", "same", "s.*")
    met = sides.join(where, ["label", "width", "cell", "block"]).where(has("visits", "other"))
    dealt = met.select("pair", "same", "side", "id").join(classes.select("id", "n", "vector"), "id")

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by([("side", "ascending"), ("id", "ascending")])
        ids, n = table["id"].to_numpy(), table["n"].to_numpy()
        links = Links(n)
        dual_traversal(_matrix(table["vector"]), int((table["side"].to_numpy() == 0).sum()), cosine, links, bool(table["same"][0].as_py()))
        at = np.flatnonzero(links.count)
        return pa.table({"a": ids[at], "b": ids[[links.root(int(i)) for i in at]] if len(at) else ids[at], "n": links.count[at]})

    found = materialize(dealt.groupBy("pair").applyInArrow(compare, "a bigint, b bigint, n bigint"), "found")
    counts = found.groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("links"))
    labels = components(found.select("a", "b"))
    tree = classes.select("id", "label", "width", "digest", "n", "least").join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = tree.groupBy("component").agg(F.min("least").alias("component_id"))
    tree = tree.join(least, "component").join(counts, "id", "left").select("label", F.col("width"), "digest", "component_id", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    rows = rows.select("vec_id", "label", F.size("vector").alias("width"), "digest")
    out = rows.join(tree, ["label", "width", "digest"], "left")
    component = F.when(F.col("digest").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull()))
