"""Manifests, corpora, service outputs, and the graph as files."""

from __future__ import annotations

import json
import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import milliseconds, slug, truncate
from ..schemas import CORPUS, MANIFEST


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Shows of a JSON manifest; a blank or repeated id, a blank url, or audio for an unknown host is an error."""
    rows = spark.read.schema(MANIFEST).option("multiLine", True).option("mode", "FAILFAST").json(path).select(F.explode("rows").alias("r")).select("r.*")
    blank = (F.coalesce("show_id", F.lit("")) == "") | (F.coalesce("feed_url", F.lit("")) == "")
    stray = F.size(F.array_except(F.map_keys(F.coalesce("reference_audio", F.create_map().cast("map<string,string>"))), F.coalesce("known_hosts", F.array().cast("array<string>")))) > 0
    if not rows.where(blank | stray).isEmpty() or not rows.groupBy("show_id").count().where("count > 1").isEmpty():
        raise ValueError(f"{path}: ids must be given once, urls not be blank, and reference audio belong to known hosts")
    return rows


def write_manifest(rows: DataFrame, path: str, version: int = 1) -> None:
    """Pretty JSON in a stable order; a manifest is small and written by the driver."""
    shows = [json.loads(r[0]) for r in rows.orderBy("show_id").select(F.to_json(F.struct(*rows.columns))).collect()]
    Path(path).write_text(json.dumps({"version": version, "rows": shows}, indent=2, ensure_ascii=False) + "\n")


def shows_of_domain(shows: DataFrame, domain: str) -> DataFrame:
    return shows.where(F.array_contains("domains", domain))


def read_corpus(spark: SparkSession, path: str, ingested: str) -> DataFrame:
    """Episodes of a corpus file; a blank date takes the time of ingestion."""
    e = spark.read.schema(CORPUS).option("multiLine", True).option("mode", "FAILFAST").json(path).select(F.explode("episodes").alias("e"))
    date = F.try_to_timestamp("e.date", F.lit("yyyy-MM-dd"))
    return e.select(F.col("e.id").alias("episode_id"), slug("e.show", "show").alias("show_id"), F.col("e.title").alias("title"), F.coalesce(date, F.lit(ingested).cast("timestamp")).alias("published_at"), F.col("e.url").alias("url"), _people().alias("known_speakers"))


def _people():
    names = F.concat(F.array(F.col("e.host")), F.coalesce("e.guests", F.array().cast("array<string>")))
    return F.array_distinct(F.filter(names, lambda n: F.coalesce(F.trim(n), F.lit("")) != ""))


def speech_service(raw: DataFrame) -> DataFrame:
    """Utterances of a speech service (episode_id, raw JSON in milliseconds) as segments in order of time; blank ones go."""
    kind = "utterances array<struct<speaker: string, text: string, start: string, end: string>>"
    u = raw.select("episode_id", F.posexplode(F.from_json("raw", kind)["utterances"]).alias("i", "u")).where("trim(coalesce(u.text, '')) <> ''")
    start = milliseconds("u.start")
    rows = u.select("episode_id", "i", F.col("u.speaker").alias("speaker"), F.trim("u.text").alias("text"), start.alias("t_start"), F.greatest(start, milliseconds("u.end")).alias("t_end"))
    from pyspark.sql import Window

    order = Window.partitionBy("episode_id").orderBy("t_start", "t_end", "i")
    return rows.withColumn("seg_idx", F.row_number().over(order) - 1).drop("i")


def graph_nodes(speakers: DataFrame, entities: DataFrame, claims: DataFrame) -> DataFrame:
    """Nodes of a viewer: id, label, group; a claim's label is cut to 60 characters."""
    s = speakers.select(F.col("speaker_id").alias("id"), F.col("name").alias("label"), F.lit("speaker").alias("group"))
    e = entities.select(F.col("canonical_id").alias("id"), F.col("canonical_name").alias("label"), F.lit("entity").alias("group"))
    c = claims.select(F.col("claim_id").alias("id"), truncate("object", 60).alias("label"), F.lit("claim").alias("group"))
    return s.unionByName(e).unionByName(c).orderBy("id")


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """One JSON file for a viewer, streamed row by row, so the driver holds one row at a time."""
    lines = lambda frame: (r[0] for r in frame.select(F.to_json(F.struct(*frame.columns))).toLocalIterator())
    shaped = edges.select(F.col("edge_id").alias("id"), F.col("src_id").alias("from"), F.col("dst_id").alias("to"), F.col("type").alias("label")).orderBy("id")
    part = f"{path}.part"
    with open(part, "w") as out:
        for name, frame, opening in (("nodes", nodes, "{"), ("edges", shaped, ",")):
            out.write(f'{opening}"{name}":[')
            for i, line in enumerate(lines(frame)):
                out.write(("," if i else "") + line)
            out.write("]")
        out.write("}\n")
    os.replace(part, path)


def load_graph(path: str) -> dict:
    """The graph of a file; without one, an empty graph."""
    return json.loads(Path(path).read_text()) if Path(path).exists() else {"nodes": [], "edges": []}
