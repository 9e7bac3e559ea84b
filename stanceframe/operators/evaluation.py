"""How good answers are: rubric totals, wins, agreement of raters, citations, fragmentation of entities."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text_udfs import normal_surface


def check_weights(weights: Mapping[str, float], elevated: str, demoted: Sequence[str]) -> None:
    """Weights are not negative and not all zero; the elevated one is largest, the demoted ones below all others."""
    if any(w < 0 for w in weights.values()) or sum(weights.values()) <= 0:
        raise ValueError("weights must not be negative, and their sum positive")
    if any(w >= weights[elevated] for d, w in weights.items() if d != elevated):
        raise ValueError(f"{elevated} must weigh most")
    rest = [w for d, w in weights.items() if d not in demoted]
    if any(weights[d] >= min(rest) for d in demoted):
        raise ValueError("a demoted dimension weighs as much as another one")


def rubric_totals(scores: DataFrame, weights: DataFrame, citations: DataFrame | None = None, capped: str = "attribution") -> DataFrame:
    """(query_id, arm, total): the weighted mean of raw scores (query_id, arm, dimension, raw); a missing dimension is 0.

    Where an answer has citations (query_id, arm, verified), the capped dimension is at most their verified share.
    """
    answers = scores.select("query_id", "arm").distinct()
    grid = answers.crossJoin(F.broadcast(weights.select("dimension", "weight")))  # weights: one row per dimension
    rows = grid.join(scores, ["query_id", "arm", "dimension"], "left").withColumn("raw", F.coalesce("raw", F.lit(0.0)))
    if citations is not None:
        share = citations.groupBy("query_id", "arm").agg(F.avg(F.col("verified").cast("double")).alias("cap"))
        rows = rows.join(share, ["query_id", "arm"], "left").withColumn("raw", F.when(F.col("dimension") == capped, F.least("raw", F.coalesce("cap", "raw"))).otherwise(F.col("raw")))
    return rows.groupBy("query_id", "arm").agg((F.sum(F.col("weight") * F.col("raw")) / F.sum("weight")).alias("total"))


def mean_totals(totals: DataFrame, arms: DataFrame) -> DataFrame:
    """Mean total of every arm; 0 for one without answers."""
    means = totals.groupBy("arm").agg(F.avg("total").alias("mean_total"))
    return arms.select("arm").join(means, "arm", "left").withColumn("mean_total", F.coalesce("mean_total", F.lit(0.0)))


def strict_wins(totals: DataFrame, arms: DataFrame) -> DataFrame:
    """Queries that an arm wins alone; a tie at the top counts for nobody."""
    best = totals.groupBy("query_id").agg(F.max("total").alias("total"))
    top = totals.join(best, ["query_id", "total"]).groupBy("query_id").agg(F.min("arm").alias("arm"), F.count(F.lit(1)).alias("n")).where("n = 1")
    return arms.select("arm").join(top.groupBy("arm").agg(F.count(F.lit(1)).alias("wins")), "arm", "left").withColumn("wins", F.coalesce("wins", F.lit(0)).cast("bigint"))


def kappa(ratings: DataFrame) -> DataFrame:
    """One row: n, agreement and Cohen's kappa of two raters (a, b). Full chance agreement gives 1 or 0."""
    cells = ratings.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    total = cells.agg(F.sum("n").alias("n"), (F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)) / F.sum("n")).alias("agreement"))
    a = cells.groupBy(F.col("a").alias("label")).agg(F.sum("n").alias("na"))
    b = cells.groupBy(F.col("b").alias("label")).agg(F.sum("n").alias("nb"))
    chance = a.join(b, "label").agg(F.coalesce(F.sum(F.col("na") * F.col("nb")), F.lit(0)).alias("both"))
    pe = F.col("both") / (F.col("n") * F.col("n"))
    value = F.when(F.abs(1 - pe) < 1e-12, F.when(F.col("agreement") >= 1, 1.0).otherwise(0.0)).otherwise((F.col("agreement") - pe) / (1 - pe))
    return total.crossJoin(chance).select("n", "agreement", value.alias("kappa"))  # one row each


def fragmentation(nodes: DataFrame, probes: DataFrame) -> DataFrame:
    """Per probe (probe, aliases, qid) how many canonical ids (canonical_id, name, aliases, qid) stand for it: those with
    its qid or one of its aliases, compared case folded and without edge punctuation."""

    def names(frame: DataFrame, keys: list[str], first: str) -> DataFrame:
        each = frame.select(*keys, F.explode(F.concat(F.array(first), F.coalesce("aliases", F.array().cast("array<string>")))).alias("alias"))
        return each.withColumn("alias", F.regexp_replace(normal_surface("alias"), r"(?U)^\W+|\W+$", "")).where("alias <> ''")

    by_name = names(nodes, ["canonical_id"], "name").join(names(probes, ["probe"], "probe"), "alias").select("probe", "canonical_id")
    by_qid = nodes.where("qid is not null").join(probes.where("qid is not null").select("probe", "qid"), "qid").select("probe", "canonical_id")
    found = by_name.union(by_qid).groupBy("probe").agg(F.count_distinct("canonical_id").alias("fragments"))
    return probes.select("probe").join(found, "probe", "left").withColumn("fragments", F.coalesce("fragments", F.lit(0)).cast("bigint"))


def fragmentation_report(found: DataFrame) -> DataFrame:
    """One row of `fragmentation`: n_probes, mean_fragments (0 without probes), and the worst probe with its fragments; of
    equally bad ones the first by name."""
    worst = F.min_by(F.struct("probe", "fragments"), F.struct(-F.col("fragments"), F.col("probe"))).alias("worst")
    return found.agg(F.count(F.lit(1)).alias("n_probes"), F.coalesce(F.avg("fragments"), F.lit(0.0)).alias("mean_fragments"), worst).select("n_probes", "mean_fragments", F.col("worst.probe").alias("worst_probe"), F.col("worst.fragments").alias("worst_fragments"))


def approach_score(run: DataFrame) -> DataFrame:
    """Rates of a run from its one row of counts; a division by nothing is 0, a parse rate without attempts is null."""
    ratio = lambda a, b: F.coalesce(F.call_function("try_divide", F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    return run.select(
        (60 * ratio("episodes", "seconds")).alias("episodes_per_minute"), ratio("cost", "episodes").alias("cost_per_episode"), ratio("claims", "episodes").alias("claims_per_episode"),
        ratio("valid_spans", "claims").alias("valid_span_rate"), ratio("valid_speakers", "claims").alias("valid_attribution_rate"), F.call_function("try_divide", F.col("parsed").cast("double"), F.col("attempts").cast("double")).alias("parse_rate"),
    )


def coverage(queries: DataFrame) -> DataFrame:
    return queries.agg(F.array_sort(F.collect_set("domain")).alias("domains"), F.array_sort(F.collect_set("archetype")).alias("archetypes"))


def blinded(answers: DataFrame, seed: int) -> DataFrame:
    """Answers (query_id, arm) with a label that hides the arm: the order of a seeded hash within the query."""
    from pyspark.sql import Window

    order = Window.partitionBy("query_id").orderBy(F.xxhash64(F.lit(seed), "query_id", "arm"), "arm")
    return answers.withColumn("label", F.concat(F.lit("answer_"), F.char(F.row_number().over(order) + 64)))


def unblinded(scores: DataFrame, key: DataFrame) -> DataFrame:
    """Scores by (query_id, label) with the arm behind each label."""
    return scores.join(key.select("query_id", "label", "arm"), ["query_id", "label"])


def verified_citations(citations: DataFrame) -> DataFrame:
    """Verified and rejected citations of each answer (query_id, arm)."""
    return citations.groupBy("query_id", "arm").agg(F.count_if("verified").alias("n_verified"), F.count_if(~F.col("verified")).alias("n_rejected"))


def recommend(a: dict[str, float], b: dict[str, float]) -> str:
    """Quality plus cheapness plus throughput, each against the better one; ties go to b."""
    top = max(a["episodes_per_minute"], b["episodes_per_minute"]) or 1.0
    cost = max(a["cost_per_episode"], b["cost_per_episode"]) or 1.0
    value = lambda x: (x["valid_span_rate"] + x["valid_attribution_rate"]) / 2 + 1 - x["cost_per_episode"] / cost + x["episodes_per_minute"] / top
    return "a" if value(a) > value(b) else "b"
