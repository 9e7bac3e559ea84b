"""Scalar expressions over columns; all stay inside Catalyst."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import STANCE_SIGN

ColumnLike = Column | str


def col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ids -----------------------------------------------------------------------------------------------------------------
def content_id(prefix: str, *parts: ColumnLike, digits: int = 16) -> Column:
    """``prefix-`` and the first hex digits of SHA-1 over the parts joined by a unit separator; null parts are empty."""
    joined = F.concat_ws("\x1f", *[F.coalesce(col(p).cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit(f"{prefix}-"), F.substring(F.sha1(joined), 1, digits))


def seconds_text(t: ColumnLike) -> Column:
    """Seconds with three decimals, as identifiers carry them."""
    return F.call_function("format_number", col(t), F.lit("0.000"))


def claim_id(speaker: ColumnLike, predicate: ColumnLike, subject: ColumnLike, obj: ColumnLike, episode: ColumnLike, t_start: ColumnLike) -> Column:
    return content_id("claim", speaker, predicate, subject, obj, episode, seconds_text(t_start))


def edge_id(kind: ColumnLike, src: ColumnLike, dst: ColumnLike) -> Column:
    """One edge per (type, source, target), ever."""
    return content_id("edge", kind, src, dst)


def speaker_id(qid: ColumnLike, name: ColumnLike) -> Column:
    return F.coalesce(F.concat(F.lit("spk-wd-"), blank_to_null(qid)), content_id("spk", name, digits=10))


# text ----------------------------------------------------------------------------------------------------------------
def blank_to_null(c: ColumnLike) -> Column:
    return F.nullif(col(c), F.lit(""))


def collapse(c: ColumnLike) -> Column:
    """Runs of Unicode white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(col(c), r"(?U)\s+", " "))


def normal_name(c: ColumnLike) -> Column:
    return F.lower(collapse(c))


def slug(c: ColumnLike, default: str = "") -> Column:
    cut = F.regexp_replace(F.regexp_replace(F.lower(col(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(cut == "", F.lit(default)).otherwise(cut)


def episode_from_url(url: ColumnLike) -> Column:
    """The last part of a url's path as a slug, without .pdf or .html."""
    path = F.regexp_replace(F.regexp_replace(col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", ""), r"[?#].*$", "")
    last = F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1)
    return slug(F.regexp_replace(last, r"(?i)\.(pdf|html?)$", ""), "transcript")


def host_of(url: ColumnLike) -> Column:
    """Lower-cased host without user, port and ``www.``."""
    authority = F.regexp_extract(col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)
    return F.regexp_replace(F.regexp_replace(F.lower(F.regexp_replace(authority, "^.*@", "")), r":\d+$", ""), r"^www\.", "")


def tokens(c: ColumnLike) -> Column:
    """ASCII letters and digits of the lower-cased text; other characters part words."""
    return F.regexp_extract_all(F.lower(col(c)), F.lit("[A-Za-z0-9]+"), F.lit(0))


def token_jaccard(a: ColumnLike, b: ColumnLike) -> Column:
    x, y = F.array_distinct(tokens(a)), F.array_distinct(tokens(b))
    both = F.size(F.array_intersect(x, y))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(both / (F.size(x) + F.size(y) - both))


def word_count(c: ColumnLike) -> Column:
    """Words between white space; one at least."""
    return F.greatest(F.lit(1), F.size(F.filter(F.split(col(c), r"(?U)\s+"), lambda w: w != "")))


def parse_hms(c: ColumnLike) -> Column:
    """Seconds of the first H:MM:SS or MM:SS in the text; null without one."""
    found = F.regexp_extract(col(c), r"(?:\d+:)?\d{1,2}:\d{2}(?:\.\d+)?", 0)
    parts = F.reverse(F.split(found, ":"))
    at = lambda i: F.coalesce(F.try_element_at(parts, F.lit(i)).cast("double"), F.lit(0.0))
    return F.when(found != "", at(3) * 3600 + at(2) * 60 + F.element_at(parts, 1).cast("double"))


#: Cues in round brackets that are not speech.
CUES = "laughs?|laughing|laughter|music|applause|crosstalk|inaudible|unintelligible|sighs?|pause|silence|noise|chuckles?|coughs?"


def clean_text(c: ColumnLike) -> Column:
    """Text without [brackets] and cues."""
    return collapse(F.regexp_replace(F.regexp_replace(col(c), r"\[[^\]]*\]", " "), rf"(?i)\(\s*(?:{CUES})[^)]*\)", " "))


def truncate(c: ColumnLike, limit: int) -> Column:
    return F.when(F.length(col(c)) > limit, F.concat(F.substring(col(c), 1, limit - 1), F.lit("…"))).otherwise(col(c))


def milliseconds(c: ColumnLike) -> Column:
    return F.greatest(F.lit(0.0), F.coalesce(F.call_function("try_divide", col(c).try_cast("double"), F.lit(1000.0)), F.lit(0.0)))


def published_at(c: ColumnLike, ingested: ColumnLike) -> Column:
    """Unix seconds or ISO text as a timestamp; what cannot be read takes the time of ingestion."""
    return F.coalesce(F.timestamp_seconds(col(c).try_cast("double")), F.try_to_timestamp(col(c)), col(ingested))


# numbers -------------------------------------------------------------------------------------------------------------
def clamp(c: ColumnLike, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), col(c)))


def overlap(a_start: ColumnLike, a_end: ColumnLike, b_start: ColumnLike, b_end: ColumnLike) -> Column:
    return F.greatest(F.lit(0.0), F.least(col(a_end), col(b_end)) - F.greatest(col(a_start), col(b_start)))


def bin_of(score: ColumnLike, edges: list[float]) -> Column:
    """Which of the bands between ``edges``; a score at an edge goes up."""
    return sum((F.when(col(score) >= e, 1).otherwise(0) for e in edges), F.lit(0))


def dot(a: ColumnLike, b: ColumnLike) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: ColumnLike) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: ColumnLike, b: ColumnLike) -> Column:
    """0 where a vector has no length; vectors of different sizes are an error."""
    sizes = F.assert_true(F.size(col(a)) == F.size(col(b)), "vectors differ in size")
    n = norm(a) * norm(b)
    return F.when(sizes.isNotNull(), F.lit(None).cast("double")).when(n == 0, 0.0).otherwise(dot(a, b) / n)


# claims --------------------------------------------------------------------------------------------------------------
def stance_sign(stance: ColumnLike) -> Column:
    signs = F.create_map(*[F.lit(x) for kv in STANCE_SIGN.items() for x in kv])
    return F.coalesce(F.try_element_at(signs, col(stance)), F.lit(0.0))


def polarity(stance: ColumnLike, sentiment: ColumnLike) -> Column:
    """Sign of the stance times the strength of the sentiment; a sentiment of 0 counts as full strength."""
    s = F.coalesce(col(sentiment), F.lit(0.0))
    return stance_sign(stance) * F.when(s == 0, 1.0).otherwise(F.abs(s))


def weight(confidence: ColumnLike) -> Column:
    return F.when(col(confidence) > 0, col(confidence)).otherwise(1e-9)


def subject_key(canonical_id: ColumnLike, name: ColumnLike) -> Column:
    return F.coalesce(blank_to_null(canonical_id), col(name))


def speaker_key(resolved_id: ColumnLike, name: ColumnLike, label: ColumnLike) -> Column:
    return F.coalesce(blank_to_null(resolved_id), blank_to_null(name), col(label))
