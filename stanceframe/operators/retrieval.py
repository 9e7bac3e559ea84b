"""Rankings by meaning, words and graph distance, and their fusion."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.scalars import cosine, tokens
from . import lexical, nearest

#: BM25's k1 and b, the constant of reciprocal ranks.
K1, B, RRF_K = 1.5, 0.75, 60


def cosine_ranking(items: DataFrame, query: Sequence[float], *, id_col: str = "claim_id", vector_col: str = "embedding") -> DataFrame:
    """(id, score, rank) of every item against a query vector; ties by id."""
    scored = items.select(F.col(id_col).alias("id"), cosine(vector_col, F.lit([float(x) for x in query])).alias("score"))
    return scored.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))


def cosine_topk(items: DataFrame, query: Sequence[float], k: int, *, id_col: str = "claim_id", vector_col: str = "embedding", ties: Sequence[str] = ()) -> DataFrame:
    """The k nearest items; without the full ranking, so each task sends k rows. k <= 0 gives none."""
    scored = items.withColumn("score", cosine(vector_col, F.lit([float(x) for x in query])))
    return scored.orderBy(F.desc("score"), *(ties or [id_col])).limit(max(0, k))


def topk_by_type(mentions: DataFrame, entities: DataFrame, k: int = 5) -> DataFrame:
    """For each mention (mention_id, entity_type, vector) the k nearest entities of its type; ties in insertion order."""
    near = nearest.nearest_by_type(mentions, entities, max(1, k))
    order = Window.partitionBy("mention_id").orderBy(F.desc("score"), "insert_seq")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def bm25(docs: DataFrame, queries: DataFrame, *, id_col: str = "claim_id", text_col: str = "text", top: int | None = None) -> DataFrame:
    """(query_id, id, score) of documents that share a term with a query (query_id, query).

    Corpus statistics are those of ``docs`` as given, so filter first; they are read when this is called. A term that a query
    repeats counts each time. Queries are sent to all tasks and documents are scored where they are read. With ``top`` only
    what may be among the best of a query is given: by the score to 9 decimals, then the id.
    """
    asked: dict = {}
    for r in queries.select("query_id", tokens("query").alias("words")).collect():
        asked.setdefault(r.query_id, Counter()).update(r.words or ())
    terms = sorted(set().union(*asked.values()))
    kind, id_kind = queries.schema["query_id"].dataType, docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("query_id", kind), T.StructField("id", id_kind), T.StructField("score", T.DoubleType())])
    if not terms:
        return docs.sparkSession.createDataFrame([], schema)
    at = {t: i for i, t in enumerate(terms)}
    wanted = [(q, [(at[t], n) for t, n in sorted(c.items())]) for q, c in asked.items()]
    rows = docs.select(F.col(id_col).alias("id"), F.lower(text_col).alias("text"))
    sums = {r.term: r.n for r in rows.mapInArrow(lexical.statistics(terms), "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    n_docs, avgdl = sums.get(lexical.DOCS, 0), sums.get(lexical.LENGTH, 0) / max(1, sums.get(lexical.TEXTS, 0)) or 1.0
    weights = [idf(n_docs, sums.get(i, 0)) for i in range(len(terms))]
    return rows.mapInArrow(lexical.scored(terms, wanted, weights, avgdl, K1, B, top, to_arrow_type(kind)), schema)


def bm25_ranking(docs: DataFrame, query: str, *, id_col: str = "claim_id", text_col: str = "text") -> DataFrame:
    """(id, score, rank) of every document, those without a query term too; ties by id."""
    asked = docs.sparkSession.createDataFrame([(0, query)], "query_id int, query string")
    scores = bm25(docs, asked, id_col=id_col, text_col=text_col).select("id", "score")
    whole = docs.select(F.col(id_col).alias("id")).join(scores, "id", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    return whole.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))


def fuse(rankings: Sequence[DataFrame], *, k: int = RRF_K, weights: Sequence[float] | None = None) -> DataFrame:
    """(id, score): the sum over rankings (id, rank) of weight / (k + rank)."""
    weights = list(weights) if weights is not None else [1.0] * len(rankings)
    if len(weights) != len(rankings):
        raise ValueError("as many weights as rankings are needed")
    parts = [r.select("id", (F.lit(float(w)) / (k + F.col("rank"))).alias("part")) for r, w in zip(rankings, weights, strict=True)]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    return union.groupBy("id").agg(F.sum("part").alias("score"))


def graph_distance(seeds: DataFrame, neighbours: DataFrame, depth: int = 1) -> DataFrame:
    """(id, hop) of what the seeds (id) reach within ``depth`` steps over (id, neighbour)."""
    reached = seeds.select("id").distinct().withColumn("hop", F.lit(0))
    frontier = reached
    for hop in range(1, depth + 1):
        step = frontier.join(neighbours, "id").select(F.col("neighbour").alias("id")).distinct()
        frontier = step.join(reached, "id", "left_anti").withColumn("hop", F.lit(hop))
        reached = reached.unionByName(frontier)
    return reached


def _walk(seeds: DataFrame, neighbours: DataFrame, universe: DataFrame, depth: int) -> DataFrame:
    inside = neighbours.join(universe.select("id"), "id", "left_semi").join(universe.select(F.col("id").alias("neighbour")), "neighbour", "left_semi")
    return graph_distance(seeds.join(universe.select("id"), "id", "left_semi"), inside, depth)


def graph_ranking(seeds: DataFrame, neighbours: DataFrame, universe: DataFrame, depth: int = 1) -> DataFrame:
    """Nodes of the universe (id) by hop, then id; paths stay inside it."""
    return _walk(seeds, neighbours, universe, depth).withColumn("rank", F.row_number().over(Window.orderBy("hop", "id")))


def _fused_best(lists: Sequence[DataFrame], k: int) -> list[tuple]:
    """(id, fused score, rank in each list or None) of the k best by reciprocal ranks over lists (id, score), each ordered by
    score, then id; ties by id. Exact without ranking the lists.

    The k first of a list have 1 / (RRF_K + k) at least, and what is among the first n of none of L lists has less than
    L / (RRF_K + n): so from n = L * (RRF_K + k) on the best are among the first n, and for them the rows before them are counted.
    """
    n = len(lists) * (RRF_K + k)
    tops = [[(r.id, r.score) for r in one.orderBy(F.desc("score"), "id").limit(n).collect()] for one in lists]
    places = [{i: at for at, (i, _) in enumerate(top, 1)} for top in tops]
    some = set().union(*places)
    least = sorted((sum(1 / (RRF_K + p[i]) for p in places if i in p) for i in some), reverse=True)
    bar = least[k - 1] if len(least) >= k else 0.0
    # in a list that holds more than its first n, one that is not among them is behind them
    most = lambda i: sum(1 / (RRF_K + p.get(i, n + 1)) for p, top in zip(places, tops, strict=True) if i in p or len(top) == n)
    some = [i for i in some if most(i) >= bar - 1e-12]
    ranks = [_places(one, [i for i in some if i not in p], p) if len(top) == n else p for one, top, p in zip(lists, tops, places, strict=True)]
    parts = lambda i: [r.get(i) for r in ranks]
    fused = [(i, sum(1 / (RRF_K + r) for r in parts(i) if r is not None), *parts(i)) for i in some]
    return sorted(fused, key=lambda r: (-r[1], r[0]))[:k]


def _places(scored: DataFrame, ids: list, known: dict) -> dict:
    """The ranks of these ids in (id, score) by score, then id, beside known ones: how many rows are before each, and one."""
    if not ids:
        return known
    asked = scored.sparkSession.createDataFrame([(i,) for i in ids], T.StructType([scored.schema["id"]]))
    at = scored.join(F.broadcast(asked), "id", "left_semi").select(F.col("id").alias("asked"), F.col("score").alias("level")).collect()
    if not at:
        return known
    # their number is bounded by the parameters
    own = F.broadcast(scored.sparkSession.createDataFrame([tuple(r) for r in at], T.StructType([T.StructField("asked", scored.schema["id"].dataType), T.StructField("level", scored.schema["score"].dataType)])))
    before = (F.col("score") > F.col("level")) | ((F.col("score") == F.col("level")) & (F.col("id") < F.col("asked")))
    counted = {r.asked: r.n for r in scored.join(own, before).groupBy("asked").agg(F.count(F.lit(1)).alias("n")).collect()}
    return known | {r.asked: counted.get(r.asked, 0) + 1 for r in at}


def hybrid(claims: DataFrame, neighbours: DataFrame, query: str, vector: Sequence[float], *, top_k: int = 10, seed_k: int = 5, depth: int = 1, traverse: bool = True) -> DataFrame:
    """Claims (claim_id, text, embedding; filter by time first) by fused rank, with the rank in each signal.

    Every claim has a lexical rank, and a semantic one if it has a vector. The best ``seed_k`` of these two start the walk over the graph.
    The search runs when this is called; no list is ranked as a whole.
    """
    if not query.strip() or top_k < 1:
        raise ValueError("a search needs a query and a positive top_k")
    spark, key = claims.sparkSession, claims.schema["claim_id"].dataType
    ids = claims.select(F.col("claim_id").alias("id"))
    near = claims.where("embedding is not null").select(F.col("claim_id").alias("id"), cosine("embedding", F.lit([float(x) for x in vector])).alias("score"))
    found = bm25(claims, spark.createDataFrame([(0, query)], "query_id int, query string"), top=None).select("id", "score")
    whole = ids.join(found, "id", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    lists = [x.persist(StorageLevel.DISK_ONLY) for x in (near, whole)]
    try:
        if traverse:
            seeds = spark.createDataFrame([r[:1] for r in _fused_best(lists, seed_k)], T.StructType([T.StructField("id", key)])) if seed_k > 0 else ids.limit(0)
            lists.append(_walk(seeds, neighbours, ids, depth).select("id", (-F.col("hop")).alias("score")).persist(StorageLevel.DISK_ONLY))
        best = _fused_best(lists, top_k)
    finally:
        for x in lists:
            x.unpersist()
    names = ["semantic_rank", "lexical_rank", "graph_rank"]
    schema = T.StructType([T.StructField("claim_id", key), T.StructField("score", T.DoubleType()), *[T.StructField(n, T.IntegerType()) for n in names]])
    return spark.createDataFrame([r if traverse else (*r, None) for r in best], schema)


def provenance(claims: DataFrame, ref: str) -> DataFrame:
    """The claim of this id, else the first by claim_id whose text contains the reference; none for a blank one."""
    needle = ref.strip().lower()
    exact = F.col("claim_id") == ref.strip()
    within = F.instr(F.lower("text"), needle) > 0
    return claims.where((exact | within) if needle else F.lit(False)).orderBy(F.when(exact, 0).otherwise(1), "claim_id").limit(1)


def dominant_subject(hits: DataFrame) -> DataFrame:
    """The most frequent subject among hits; ties to the smaller id."""
    return hits.where("coalesce(subject, '') <> ''").groupBy("subject").count().orderBy(F.desc("count"), "subject").limit(1)


def idf(n_docs: int, df: int) -> float:
    return max(0.0, math.log((n_docs - df + 0.5) / (df + 0.5) + 1))
