"""Who and what is meant: exact names, cascades of thresholds, galleries, guests, greedy clusters."""

from __future__ import annotations

import functools
import math
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import content_id, cosine, normal_name, slug, speaker_id
from ..functions.text_udfs import normal_surface
from . import nearest

#: Cosine from which an entity matches, and below which it is new, by type.
THRESHOLDS = {"organization": (0.86, 0.62), "person": (0.86, 0.62), "concept": (0.90, 0.70), "work": (0.90, 0.70)}


def exact_matches(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """(mention_id, canonical_id) by type and normal name or alias; of several the first inserted."""
    names = entities.select("entity_type", "canonical_id", "insert_seq", F.explode(F.concat(F.array("canonical_name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("alias"))
    names = names.withColumn("key", normal_surface("alias")).groupBy("entity_type", "key").agg(F.min_by("canonical_id", "insert_seq").alias("canonical_id"))
    return mentions.withColumn("key", normal_surface("name")).join(names, ["entity_type", "key"]).select("mention_id", "canonical_id")


def cascade(mentions: DataFrame, entities: DataFrame, thresholds: Mapping[str, tuple[float, float]] = THRESHOLDS) -> DataFrame:
    """(mention_id, canonical_id, tier): by qid, by exact name, by the nearest vector above the type's threshold, else new;
    between the two thresholds the pair waits for a judge (tier ``ask``)."""
    qids = entities.where("qid is not null").groupBy("entity_type", "qid").agg(F.min_by("canonical_id", "insert_seq").alias("by_qid"))
    out = mentions.join(qids, ["entity_type", "qid"], "left").join(exact_matches(mentions, entities).withColumnRenamed("canonical_id", "by_name"), "mention_id", "left")
    left = out.where("by_qid is null and by_name is null").select("mention_id", "entity_type", "vector")
    near = nearest.nearest_by_type(left, entities.select("entity_type", "canonical_id", "insert_seq", F.col("embedding").cast("array<double>").alias("embedding")), 1, counted=mentions)
    best = near.groupBy("mention_id").agg(F.max_by(F.struct("canonical_id", "score"), F.struct("score", -F.col("insert_seq"))).alias("best"))
    limits = F.create_map(*[x for t, (hi, lo) in thresholds.items() for x in (F.lit(t), F.struct(F.lit(hi).alias("hi"), F.lit(lo).alias("lo")))])
    out = out.join(best, "mention_id", "left").withColumn("limit", F.element_at(limits, F.col("entity_type")))
    score = F.col("best.score")
    tier = F.when(F.col("by_qid").isNotNull(), "qid").when(F.col("by_name").isNotNull(), "exact").when(score >= F.col("limit.hi"), "embedding").when(score < F.col("limit.lo"), "new").when(score.isNull(), "new").otherwise("ask")
    return out.withColumn("tier", tier).select("mention_id", F.coalesce("by_qid", "by_name", F.when(F.col("tier").isin("embedding", "ask"), F.col("best.canonical_id"))).alias("canonical_id"), "tier", score.alias("score"))


def gallery(samples: DataFrame) -> DataFrame:
    """(host_id, centroid): the mean of a host's sample vectors."""
    each = samples.select("host_id", F.posexplode("vector").alias("i", "x")).groupBy("host_id", "i").agg(F.avg("x").alias("x"))
    return each.groupBy("host_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("centroid"))


def match_voices(voices: DataFrame, hosts: DataFrame, threshold: float = 0.75, margin: float = 0.05, hosts_per_part: int = 10_000) -> DataFrame:
    """(voice_id, host_id, score): the nearest host, null unless it reaches the threshold and leads the second by the margin.

    Every voice meets every host. Hosts are dealt into parts of about ``hosts_per_part``, so a row holds a part of the
    gallery however large it is (and a small one is sent to all tasks by Spark's own size check); each part gives its two
    best, which are merged.
    """
    parts = max(1, -(-hosts.count() // hosts_per_part))
    dealt = hosts.select(F.pmod(F.xxhash64("host_id"), F.lit(parts)).cast("int").alias("part"), F.struct("host_id", "centroid").alias("h")).groupBy("part").agg(F.collect_list("h").alias("some"))
    # a voice meets each part of the gallery once
    asked = voices.select("voice_id", "vector", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")).join(dealt, "part")
    scores = F.transform("some", lambda h: F.struct(cosine(F.col("vector"), h["centroid"]).alias("score"), h["host_id"].alias("host_id")))
    two = asked.select("voice_id", F.explode(F.slice(F.sort_array(scores, False), 1, 2)).alias("m"))
    tops = two.groupBy("voice_id").agg(F.slice(F.sort_array(F.collect_list("m"), False), 1, 2).alias("tops")).select("voice_id", F.get("tops", F.lit(0)).alias("best"), F.get("tops", F.lit(1))["score"].alias("second"))
    ok = (F.col("best.score") >= threshold) & (F.col("best.score") - F.coalesce("second", F.lit(-1.0)) >= margin)
    return tops.select("voice_id", F.when(ok, F.col("best.host_id")).alias("host_id"), F.col("best.score").alias("score"))


def recurring_guests(appearances: DataFrame, candidates: DataFrame | None = None, least: int = 2) -> DataFrame:
    """Names (episode_id, name, from_metadata, seq) in at least two episodes; with ``candidates`` (name, rank, qid) only
    those with a QID. The display name prefers metadata, then the first seen."""
    rows = appearances.withColumn("key", normal_name("name"))
    out = rows.groupBy("key").agg(F.count_distinct("episode_id").alias("n_episodes"), F.min_by("name", F.struct(~F.col("from_metadata"), "seq")).alias("name")).where(F.col("n_episodes") >= least)
    if candidates is None:
        return out.withColumn("guest_id", F.concat(F.lit("guest-"), slug("name")))
    best = candidates.groupBy(normal_name("name").alias("key")).agg(F.min_by("qid", "rank").alias("qid"))
    return out.join(best, "key").withColumn("guest_id", F.concat(F.lit("guest-"), "qid"))


def pick_candidates(entities: DataFrame, candidates: DataFrame, hints: DataFrame) -> DataFrame:
    """(entity_id, qid): of ranked candidates (name, rank, qid, description) the first whose description holds a hint
    (entity_id, hint), else the first. Only people and organizations are looked up."""
    people = entities.where("entity_type in ('person', 'organization')").select("entity_id", "name")
    # what a name, and a name with a hint, choose does not depend on the entity: none meets all candidates of its name
    told = candidates.groupBy("name", F.lower("description").alias("description")).agg(F.min(F.struct("rank", "qid")).alias("first"))
    asked = people.join(hints.select("entity_id", F.lower("hint").alias("hint")).where("hint is not null").distinct(), "entity_id")
    hits = asked.select("name", "hint").distinct().join(told, "name").where(F.instr("description", F.col("hint")) > 0).groupBy("name", "hint").agg(F.min("first").alias("first"))
    chosen = asked.join(hits, ["name", "hint"]).select("entity_id", F.lit(0).alias("miss"), "first")
    others = people.join(told.groupBy("name").agg(F.min("first").alias("first")), "name").select("entity_id", F.lit(1).alias("miss"), "first")
    return chosen.unionByName(others).groupBy("entity_id").agg(F.min(F.struct("miss", "first")).alias("best")).select("entity_id", F.col("best.first.qid").alias("qid"))


def canonical_speakers(names: DataFrame) -> DataFrame:
    """(speaker_id, display_name, qid) of names (name, qid, seq): one per QID, else per normal name; the first spelling stays."""
    rows = names.withColumn("speaker_id", speaker_id("qid", normal_name("name")))
    return rows.groupBy("speaker_id").agg(F.min_by("name", "seq").alias("display_name"), F.max("qid").alias("qid"))


def resolve_labels(labels: DataFrame, *resolvers: DataFrame) -> DataFrame:
    """The first resolver (episode_id, label, resolved_id) that knows a label of an episode decides."""
    out = labels
    for i, r in enumerate(resolvers):
        out = out.join(r.select("episode_id", "label", F.col("resolved_id").alias(f"_{i}")), ["episode_id", "label"], "left")
    return out.select(*labels.columns, F.coalesce(*[F.col(f"_{i}") for i in range(len(resolvers))]).alias("resolved_id"))


def merge_aliases(entities: DataFrame) -> DataFrame:
    """(canonical_id, aliases): union over records (canonical_id, alias, seq), distinct by normal form, first spelling kept."""
    first = entities.withColumn("key", normal_surface("alias")).groupBy("canonical_id", "key").agg(F.min(F.struct("seq", "alias")).alias("a"))
    return first.groupBy("canonical_id").agg(F.transform(F.array_sort(F.collect_list("a")), lambda s: s["alias"]).alias("aliases"))


def cluster_forms(forms: DataFrame, threshold: float = 0.85, block: int = nearest.BLOCK) -> DataFrame:
    """Greedy clusters of distinct forms (entity_type, form, vector): longest first, each joins the nearest seed at the
    threshold (of equals the later), else it is a seed. Sequential by definition, in rounds: the next ``block`` forms of every
    type meet the seeds so far, each part of them in a task of its own, then each other.
    """
    rounds = -(-(forms.groupBy("entity_type").count().agg(F.max("count")).first()[0] or 0) // block)
    order = Window.partitionBy("entity_type").orderBy(F.desc(F.length("form")), "form")
    doubles = F.col("vector").cast("array<double>").alias("vector")
    numbered = forms.select(F.col("entity_type").cast("string").alias("entity_type"), "form", doubles).withColumn("at", F.row_number().over(order) - 1)
    if rounds < 2:
        settled = [numbered.groupBy("entity_type").applyInArrow(nearest.settle_first(threshold), nearest.SETTLED)]
    else:
        numbered, settled = nearest.kept(numbered), []
        for k in range(rounds):
            here = numbered.where(F.col("at").between(k * block, (k + 1) * block - 1))
            if k == 0:
                out = here.groupBy("entity_type").applyInArrow(nearest.settle_first(threshold), nearest.SETTLED)
            else:
                # a quarter of the block against the seeds of one round
                asked = here.select("entity_type", "at", "vector", F.pmod("at", F.lit(4)).alias("part"), F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("round"))
                seeds = functools.reduce(DataFrame.unionByName, [s.where("vector is not null").withColumn("round", F.lit(j)) for j, s in enumerate(settled)])
                seeds = seeds.select("entity_type", "form", "at", "vector", F.explode(F.array(*map(F.lit, range(4)))).alias("part"), "round")
                keys = ["entity_type", "round", "part"]
                found = asked.groupBy(*keys).cogroup(seeds.groupBy(*keys)).applyInArrow(nearest.nearest_seeds(threshold), nearest.FOUND)
                out = here.groupBy("entity_type").cogroup(found.groupBy("entity_type")).applyInArrow(nearest.settle(threshold), nearest.SETTLED)
            settled.append(nearest.kept(out))
    clustered = functools.reduce(DataFrame.unionByName, settled).select("entity_type", "form", "seed")
    return clustered.withColumn("canonical_id", content_id("ent", "entity_type", "seed", digits=12))


RESOLVED = "entity_type string, form string, canonical_id string, tier string"


def resolve_incremental(forms: DataFrame, store: DataFrame, thresholds: Mapping[str, tuple[float, float]] = THRESHOLDS) -> DataFrame:
    """(entity_type, form, canonical_id, tier) of forms (entity_type, form, name, qid, vector, seq) against a store, in order.

    Each form sees what the forms before it have added: by qid, then normal name or alias, then the nearest vector at the
    type's upper threshold; else it is new, ``wd-<qid>`` or a content id. Sequential by definition, so a type is one group;
    only forms that no name in the store equals need it, which a join has settled before.
    """
    known = exact_matches(forms.select("form", "entity_type", "name").withColumnRenamed("form", "mention_id"), store)
    open_forms = forms.join(known.select(F.col("mention_id").alias("form"), F.lit(True).alias("hit")), "form", "left").where("hit is null or qid is not null").drop("hit")
    minted = content_id("ent", "entity_type", "form", digits=12)
    fresh = open_forms.withColumn("minted", F.coalesce(F.concat(F.lit("wd-"), "qid"), minted))

    def run(new: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
        qids, names, vectors = {}, {}, []
        unit = lambda v: [x / n for x in v] if (n := math.sqrt(sum(x * x for x in v))) else list(v)
        for r in old.sort_values("insert_seq").itertuples():
            if isinstance(r.qid, str):
                qids.setdefault(r.qid, r.canonical_id)
            for key in r.keys:
                names.setdefault(key, r.canonical_id)
            if r.embedding is not None:
                vectors.append((unit(r.embedding), r.canonical_id))
        out = []
        for r in new.sort_values("seq").itertuples():
            v, qid = unit(r.vector) if r.vector is not None else None, r.qid if isinstance(r.qid, str) else None
            tier, found = ("qid", qids[qid]) if qid in qids else ("exact", names[r.form]) if r.form in names else ("new", None)
            if found is None and v is not None and vectors:
                score, near = max(((sum(x * y for x, y in zip(v, w, strict=True)), i) for w, i in vectors), key=lambda s: s[0])
                if score >= thresholds[r.entity_type][0]:
                    tier, found = "embedding", near
            found = found or r.minted
            out.append((r.entity_type, r.form, found, tier))
            names.setdefault(r.form, found)
            if qid:
                qids.setdefault(qid, found)
            if v is not None:
                vectors.append((v, found))
        return pd.DataFrame(out, columns=["entity_type", "form", "canonical_id", "tier"])

    aliases = F.concat(F.array("canonical_name"), F.coalesce("aliases", F.array().cast("array<string>")))
    keyed = store.select("entity_type", "canonical_id", "qid", "embedding", "insert_seq", F.explode(aliases).alias("alias")).withColumn("key", normal_surface("alias"))
    kept = keyed.groupBy("entity_type", "canonical_id").agg(F.min("qid").alias("qid"), F.min_by("embedding", "insert_seq").alias("embedding"), F.min("insert_seq").alias("insert_seq"), F.collect_set("key").alias("keys"))
    solved = fresh.groupBy("entity_type").cogroup(kept.groupBy("entity_type")).applyInPandas(run, RESOLVED)
    by_name = known.join(open_forms.select(F.col("form").alias("mention_id")), "mention_id", "left_anti").join(forms.select(F.col("form").alias("mention_id"), "entity_type"), "mention_id")
    return solved.unionByName(by_name.select("entity_type", F.col("mention_id").alias("form"), "canonical_id", F.lit("exact").alias("tier")))
