"""Quality classifier: a sparse ensemble of rules over text statistics.

1. Statistics of every whole text, in one pass (`statistics`).
2. Shallow boosted trees on a bounded sample of labelled rows; each path from a root to a node is a conjunctive rule.
3. A logistic model with an L1 penalty weighs the rules; most get no weight.
4. What is left becomes one Spark column expression over the statistics, so scoring is a projection.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices, text_column

#: Labelled rows that are learned from, at most: those with the smallest hashes of their identifiers.
TRAIN_ROWS = 12_000
#: Rows with this remainder of crc32(doc_id as text) by 4 are never learned from.
HELD_OUT = 2
STATISTICS = (
    "n_chars", "n_words", "word_length", "distinct_words", "distinct_pairs", "repeats", "top_run", "upper", "digits", "stops", "symbols",
    "bars", "shouts", "lines", "distinct_lines", "line_words", "symbol_words", "bare_words",
)
_CLASS = np.zeros((256, 6), np.int64)
for _i, _chars in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".,;:?'\"()-", "#$%&*+/<=>@[\\]^_`{}~", "|", "!")):
    _CLASS[[ord(c) for c in _chars], _i] = 1
_SYMBOLS = frozenset("#$%&*+/<=>@[\\]^_`{}~|!")


def text_statistics(text: str) -> tuple[float, ...]:
    """The values of ``STATISTICS`` for one whole text; all are 0 for an empty one. Shares are of words, characters or lines."""
    words = text.split()
    if not words:
        return (float(len(text)), *[0.0] * (len(STATISTICS) - 1))
    n, raw = len(words), np.frombuffer(text.encode(), np.uint8)
    upper, digits, stops, symbols, bars, shouts = (np.bincount(raw, minlength=256) @ _CLASS / len(raw)).tolist()
    same = [*map(eq, words, words[1:])]
    run = most = 0
    if any(same):
        for x in same:
            run = run + 1 if x else 0
            most = max(most, run)
    lines = [x for x in text.split("\n") if x.strip()]
    odd = sum(w[-1] in _SYMBOLS for w in words)
    bare = sum(len(w) < 2 for w in words)
    return (
        float(len(text)), float(n), len(text) / n, len(set(words)) / n, len(set(zip(words, words[1:]))) / n, sum(same) / n, most / n, upper, digits, stops, symbols,
        bars, shouts, float(len(lines)), len(set(lines)) / len(lines), n / len(lines), odd / n, bare / n,
    )


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the statistics of every row; null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = np.array([text_statistics(t) for t in text_column(batch)]).T
            yield pa.record_batch([batch.column(0), *map(pa.array, found)], names=["doc_id", *STATISTICS])

    schema = "doc_id bigint, " + ", ".join(f"{s} double" for s in STATISTICS)
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


@dataclass(frozen=True)
class Term:
    """``statistic <= bound``, or ``>`` where ``above``."""

    statistic: int
    bound: float
    above: bool

    def holds(self, x: np.ndarray) -> np.ndarray:
        return x[:, self.statistic] > self.bound if self.above else x[:, self.statistic] <= self.bound

    def column(self, prefix: str = "") -> Column:
        c = F.col(prefix + STATISTICS[self.statistic])
        return c > self.bound if self.above else c <= self.bound


@dataclass
class RuleModel:
    """Weighted conjunctions and a bias, on the scale of log odds."""

    bias: float
    rules: list[tuple[float, tuple[Term, ...]]] = field(default_factory=list)

    def column(self, prefix: str = "") -> Column:
        """The score, 0 to 1, as an expression over the statistics."""
        total = F.lit(float(self.bias))
        for weight, terms in self.rules:
            holds = terms[0].column(prefix)
            for t in terms[1:]:
                holds = holds & t.column(prefix)
            total = total + F.when(holds, float(weight)).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def _tree(x: np.ndarray, bins: np.ndarray, edges: list[np.ndarray], target: np.ndarray, weight: np.ndarray, depth: int, rng: np.random.Generator) -> tuple[list[tuple[Term, ...]], np.ndarray]:
    """A regression tree; the paths to all its nodes, and its prediction."""
    paths: list[tuple[Term, ...]] = []
    prediction = np.zeros(len(x))
    least = max(8, len(x) // 400)

    def grow(rows: np.ndarray, path: tuple[Term, ...]) -> None:
        prediction[rows] = (target[rows].sum()) / (weight[rows].sum() + 1e-6)
        if path:
            paths.append(path)
        if len(path) == depth or len(rows) < 2 * least:
            return
        best, best_gain = None, 1e-9
        for f in rng.permutation(x.shape[1])[: max(4, 2 * x.shape[1] // 3)]:
            size = len(edges[f]) + 1
            g, h, n = (np.bincount(bins[rows, f], w, size) for w in (target[rows], weight[rows], np.ones(len(rows))))
            gl, hl, nl = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(n)[:-1]
            gr, hr, nr = g.sum() - gl, h.sum() - hl, len(rows) - nl
            gain = np.where((nl >= least) & (nr >= least), gl**2 / (hl + 1) + gr**2 / (hr + 1), -1.0)
            if len(gain) and (i := int(gain.argmax()), gain[i] - g.sum() ** 2 / (h.sum() + 1))[1] > best_gain:
                best, best_gain = (int(f), i), gain[i] - g.sum() ** 2 / (h.sum() + 1)
        if best is None:
            return
        f, i = best
        left = bins[rows, f] <= i
        for part, above in ((rows[left], False), (rows[~left], True)):
            grow(part, (*path, Term(f, float(edges[f][i]), above)))

    grow(np.arange(len(x)), ())
    return paths, prediction


def _lasso(r: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """Logistic weights with an L1 penalty, by accelerated proximal steps on centred rules."""
    n, k = r.shape
    mean = weight @ r / weight.sum()
    z = (r - mean).astype(np.float32)
    v = np.ones(k, np.float32)
    for _ in range(20):
        v = z.T @ (z @ v)
        v /= np.linalg.norm(v) + 1e-12
    rate = 1 / (0.25 * weight.max() * float(np.linalg.norm(z @ v)) ** 2 / n + 0.25)
    w, b, u, c, t = np.zeros(k), 0.0, np.zeros(k), 0.0, 1.0
    for _ in range(steps):
        miss = weight * (1 / (1 + np.exp(-np.clip(z @ u.astype(np.float32) + c, -40, 40))) - y) / n
        new = u - rate * (z.T @ miss.astype(np.float32))
        new = np.sign(new) * np.maximum(np.abs(new) - rate * penalty, 0)
        new_b = c - rate * miss.sum()
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        u, c = new + (t - 1) / s * (new - w), new_b + (t - 1) / s * (new_b - b)
        w, b, t = new, new_b, s
    return w, float(b - mean @ w)


def fit(x: np.ndarray, y: np.ndarray, *, trees: int = 60, depth: int = 3, penalty: float = 4e-4, seed: int = 7) -> RuleModel:
    """Fit on rows of statistics and labels 0/1. Without rows the score is 0.5; with one label only, that label's smoothed share."""
    n = len(y)
    if n == 0 or y.min() == y.max():
        share = (y.sum() + 1) / (n + 2)
        return RuleModel(float(np.log(share / (1 - share))))
    rng = np.random.default_rng(seed)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, 65)[1:-1])) for f in range(x.shape[1])]
    bins = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    margin, found = np.full(n, np.log(y.mean() / (1 - y.mean()))), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        paths, step = _tree(x, bins, edges, y - p, p * (1 - p), depth, rng)
        margin = margin + 0.2 * np.clip(step, -4, 4)
        found |= dict.fromkeys(paths)
    # a rule and its complement say the same: keep the first of equal or opposite columns
    rules, columns = {}, []
    for path in found:
        holds = np.logical_and.reduce([t.holds(x) for t in path])
        key = min(holds.tobytes(), (~holds).tobytes())
        if key not in rules and 0 < holds.sum() < n:
            rules[key] = path
            columns.append(holds)
    if not columns:
        return RuleModel(float(np.log(y.mean() / (1 - y.mean()))))
    w, b = _lasso(np.stack(columns, axis=1).astype(np.float32), y, np.ones(n), penalty)
    return RuleModel(b, [(float(v), path) for v, path in zip(w, rules.values(), strict=True) if abs(v) > 1e-3])


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == HELD_OUT, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, *, label_col: str = "quality", train_rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> RuleModel:
    """Learn from at most ``train_rows`` labelled documents that are not held out; null identifiers and labels are left out.

    A document with several labels counts with the smallest of them; of rows that repeat an identifier the one with the
    smallest statistics counts, so there is one row each.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label_col).isNotNull() & ~held_out())
    known = known.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.min(label_col).cast("int").alias("label"))
    sample = materialize(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows), "labelled")
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(sample.select("doc_id")), "doc_id", "left_semi")  # ``train_rows`` bounds it
    one = statistics(texts).groupBy("doc_id").agg(F.min(F.struct(*STATISTICS)).alias("s")).select("doc_id", "s.*")
    rows = one.join(F.broadcast(sample), "doc_id").toArrow().sort_by("doc_id")
    x = np.stack([rows[s].to_numpy() for s in STATISTICS], axis=1) if rows.num_rows else np.zeros((0, len(STATISTICS)))
    return fit(x, rows["label"].to_numpy().astype(float))


def score_documents(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """One row per input row: doc_id, held_out, score (0 to 1, higher: label 1 likelier), predicted (1 if score >= threshold).

    Labels, lang, source and doc_id are no inputs of a score. Null text counts as empty; an empty text has a score too.
    Repeated rows are scored each; a null identifier is not held out. Other columns are not read. Without labels every
    score is 0.5. An empty table gives no rows.
    """
    score = train(docs, labels, train_rows=train_rows, id_col=id_col, text_col=text_col).column()
    scored = statistics(docs, id_col, text_col).select("doc_id", held_out().alias("held_out"), score.alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of ``docs``, all columns, whose score reaches ``threshold``; one pass, nothing is shuffled."""
    model, name = train(docs, labels, train_rows=train_rows, id_col=id_col, text_col=text_col), "__statistics"

    @F.pandas_udf(", ".join(f"{s} double" for s in STATISTICS))
    def measured(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([text_statistics(t or "") for t in texts], columns=STATISTICS)

    return docs.withColumn(name, measured(F.col(text_col))).where(model.column(name + ".") >= threshold).drop(name)
