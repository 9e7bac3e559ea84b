"""The closed vocabulary of predicates, and how free wording is mapped to it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The vocabulary, its synonyms, and words of it that say too little alone.
PREDICATES = (
    "expects", "rates_positive", "rates_negative", "predicts", "recommends", "criticizes", "compares", "explains",
    "attributes", "forecasts", "endorses", "rejects", "questions", "agrees", "disagrees",
)
SYNONYMS = {
    "expects": ("expect", "anticipates", "anticipate", "looks forward to"),
    "rates_positive": ("rates positive", "rates positively", "is positive about", "positive on", "praises", "likes", "favorable", "bullish", "bullish on"),
    "rates_negative": ("rates negative", "rates negatively", "is negative about", "negative on", "dislikes", "unfavorable", "bearish", "bearish on"),
    "predicts": ("predict", "prediction"),
    "recommends": ("recommend", "recommendation", "suggests", "advises"),
    "criticizes": ("criticize", "criticises", "critiques", "knocks"),
    "compares": ("compare", "comparison", "contrasts"),
    "explains": ("explain", "explanation", "clarifies", "describes"),
    "attributes": ("attribute", "attribution", "credits", "ascribes"),
    "forecasts": ("forecast", "projects", "projection"),
    "endorses": ("endorse", "endorsement", "backs", "supports"),
    "rejects": ("reject", "rejection", "denies", "dismisses"),
    "questions": ("question", "questioning", "doubts", "casts doubt on"),
    "agrees": ("agree", "agreement", "concurs", "agrees with"),
    "disagrees": ("disagree", "disagreement", "disputes", "disagrees with"),
}
TOO_LITTLE = ("rates", "positive", "negative")


def _lookup(table: Mapping[str, str], key: Column) -> Column:
    if not table:
        return F.lit(None).cast("string")
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def map_predicate(raw: Column | str, vocabulary: Sequence[str] = PREDICATES, synonyms: Mapping[str, str] | None = None) -> Column:
    """A word of the vocabulary for free wording, else null: rather no claim than a wrong relation.

    Case and separators do not count. In this order: a word of the vocabulary, a synonym, either of these without a final
    s, a word of the vocabulary with one, and the first word of the phrase that stands for one alone.
    ``synonyms`` maps wordings to the vocabulary; those of the built-in vocabulary are the default for it.
    """
    if synonyms is None:
        synonyms = {s: p for p, many in SYNONYMS.items() if p in vocabulary for s in many}
    names = {v.replace("_", " "): v for v in vocabulary}
    alone: dict[str, str] = {}
    for v in vocabulary:
        for word in v.split("_"):
            if word not in TOO_LITTLE:
                alone.setdefault(word, v)
    text = F.trim(F.regexp_replace(F.lower(raw if isinstance(raw, Column) else F.col(raw)), r"[\s_\-]+", " "))
    singular = F.when(text.endswith("s"), F.regexp_replace(text, "s$", ""))
    in_word = F.transform(F.split(text, " "), lambda w: F.coalesce(_lookup(alone, w), F.when(w.endswith("s"), _lookup(alone, F.regexp_replace(w, "s$", "")))))
    return F.coalesce(
        _lookup(names, text), _lookup(synonyms, text), _lookup(names, singular), _lookup(synonyms, singular), _lookup(names, F.concat(text, F.lit("s"))),
        F.try_element_at(F.filter(in_word, lambda v: v.isNotNull()), F.lit(1)),
    )
