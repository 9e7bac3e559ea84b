"""URL filter: path rules first, then logistic regression on hashed character n-grams of host and path.

Only DataFrame functions touch the pages. The grams of the labelled table are hashed by the same column expression that
scores; its few rows reach the driver, which fits the weights by gradient descent. The weights go back into the plan as one array.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets that grams hash to, their lengths, and the most rows a labelled table may have.
BUCKETS, GRAMS, MOST_LABELLED = 8192, (3, 4, 5), 10_000
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Words of a small labelled table: 1 is to be blocked.
BLOCKED_WORDS = "adult xxx porn erotic escort nude casino poker bets betting gamble jackpot lottery slots roulette pills pharma viagra meds spam ads advert popup banner track tracker clicks malware phish warez crack keygen torrent prize loan cash payday replica farm".split()
ALLOWED_WORDS = "news library museum university school college science weather climate garden travel hotel recipes kitchen food history art design photo film music radio theatre book author poetry health hospital city council village market bank law review journal archive docs wiki forum notes paper sport football tennis cycling river mountain coast energy solar build tools code data maps space robot".split()


def _names(n: int) -> list[str]:
    """Names that say nothing, by a rule: two or three syllables of a consonant, a vowel and, at times, another consonant."""
    first, vowels, last = "bdfgklmnprstvz", "aeiou", ["", "", "n", "r", "l", "s"]
    part = lambda k: first[k % 14] + vowels[k // 14 % 5] + last[k * 11 // 7 % 6]
    return [part(i * 37) + part(i * 53 + 5) + (part(i * 29 + 2) if i % 3 else "") for i in range(1, n + 1)]


def labelled_urls(held_out: bool | None = None) -> list[tuple[str, int]]:
    """Urls of hosts with bad words, with good words, and with names that say nothing (good); paths are alike for all.

    A host joins two words or stands alone; ``held_out`` gives only, or never, the hosts of every fifth pair of words.
    """
    tops, names = ("com", "net", "org", "info", "io", "co.uk", "de", "eu"), _names(160)
    hosts = ("{w}.{top}", "www.{w}{o}.{top}", "{w}-{o}.{top}", "{o}.{w}site.{top}", "my{w}.{top}", "shop.{o}{w}.{top}")
    paths = ("", "/", "/about", "/index.php?id={n}", "/2019/04/{n}/{p}-{q}", "/category/{p}/page/3", "/watch?v={p}{n}", "/{p}/{q}.html#top", "/a/{n}/{p}/", "/login?next=/{q}")
    out = []
    for words, label in ((BLOCKED_WORDS, 1), (ALLOWED_WORDS, 0), (names, 0)):
        for i, w in enumerate(words):
            for k, host in enumerate(hosts):
                # the partner of a bad word may say anything
                o = (words, names, ALLOWED_WORDS)[(i + k) % 3 if label else 0][(3 * i + 7 * k + 1) % len(words if label == 0 or (i + k) % 3 == 0 else names if (i + k) % 3 == 1 else ALLOWED_WORDS)]
                if held_out is None or ((i + 2 * k) % 5 == 0) == held_out:
                    path = paths[(i * 3 + k) % len(paths)].format(n=17 + 31 * i, p=names[(i + k) % 160], q=names[(5 * i + k) % 160])
                    out.append((f"http{'s' * (k % 2)}://{host.format(w=w, o=o, top=tops[(i + k) % len(tops)])}{path}", label))
    return out


def host_and_path(url: str) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url column; both empty where it is null or has no ``://``."""
    text = F.coalesce(F.col(url), F.lit(""))
    at = F.instr(text, "://")
    rest = F.when(at > 0, text.substr(at + F.lit(3), F.length(text))).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, UPPER.lower()), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


@dataclass(frozen=True)
class Rule:
    """``text`` is a domain, then a path prefix from its first ``/``; it fits the domain and its subdomains."""

    action: str
    text: str

    def fits(self, host: Column, path: Column) -> Column:
        domain, _, rest = self.text.partition("/")
        return ((host == domain) | host.endswith("." + domain)) & path.startswith("/" + rest)


def grams(host: Column, path: Column) -> Column:
    """Buckets of all n-grams of host and path; the two have n-grams of their own."""

    def of(text: Column, mark: str, n: int) -> Column:
        whole = F.concat(F.lit("^"), text, F.lit("$"))
        places = F.when(F.length(whole) >= n, F.sequence(F.lit(1), F.length(whole) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.pmod(F.hash(F.lit(mark), whole.substr(i, F.lit(n))), F.lit(BUCKETS)))

    return F.concat(*[of(text, mark, n) for text, mark in ((host, "h"), (path, "p")) for n in GRAMS])


@dataclass(frozen=True)
class UrlModel:
    weights: tuple[float, ...]
    bias: float

    def score(self, host: Column, path: Column) -> Column:
        """Probability that the url is to be blocked."""
        found, table = grams(host, path), F.lit(list(self.weights))
        total = F.aggregate(found, F.lit(0.0), lambda acc, i: acc + F.get(table, i))
        return 1 / (1 + F.exp(-(F.lit(self.bias) + total / F.sqrt(F.greatest(F.size(found), F.lit(1)).cast("double")))))


def train(labelled: DataFrame, *, url_col: str = "url", label_col: str = "label", steps: int = 1000, rate: float = 4.0, decay: float = 2e-5) -> UrlModel:
    """Fit on a small table of urls labelled 1 (block) or 0; rows with a null label are left out. No rows: nothing is blocked."""
    host, path = host_and_path(url_col)
    rows = labelled.where(F.col(label_col).isNotNull()).select(grams(host, path).alias("grams"), F.col(label_col).cast("int").alias("label")).limit(MOST_LABELLED + 1).collect()
    if len(rows) > MOST_LABELLED:
        raise ValueError(f"the labelled table has more than {MOST_LABELLED} rows")
    n = len(rows)
    if not n:
        return UrlModel((0.0,) * BUCKETS, -1.0)
    seen = np.unique([g for r in rows for g in r.grams]).astype(int)
    x, y = np.zeros((n, len(seen))), np.array([r.label for r in rows], float)
    for i, r in enumerate(rows):
        np.add.at(x[i], np.searchsorted(seen, r.grams), 1 / np.sqrt(max(1, len(r.grams))))
    share = np.where(y == 1, n / (2 * max(1, y.sum())), n / (2 * max(1, n - y.sum()))) / n  # both labels weigh the same in sum
    weights, bias = np.zeros(len(seen)), 0.0
    for _ in range(steps):
        miss = share * (1 / (1 + np.exp(-np.clip(x @ weights + bias, -60, 60))) - y)
        weights -= rate * (x.T @ miss + decay * weights)
        bias -= rate * miss.sum()
    table = np.zeros(BUCKETS)
    table[seen] = weights
    return UrlModel(tuple(table.tolist()), float(bias))


def built_in_model(spark: SparkSession) -> UrlModel:
    """The model of the small labelled table above."""
    values = ", ".join(f"('{url}', {label})" for url, label in labelled_urls())
    return train(spark.sql(f"SELECT * FROM VALUES {values} AS t(url, label)"))


def judge(pages: DataFrame, rules: Sequence[Rule], model: UrlModel, *, id_col: str = "page_id", url_col: str = "url", threshold: float = 0.5) -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict, score (null where a rule decides).

    Of the rules that fit, the one with the longest text decides (of equal length the first); without one, the model
    blocks at ``threshold``. A null url or one without ``://`` has empty host and path, which no rule fits. Repeated
    rows are judged each; other columns are not read. An empty table gives no rows. Nothing is shuffled.
    """
    host, path = host_and_path(url_col)
    parts = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    host, path = F.col("host"), F.col("path")
    ordered = sorted(rules, key=lambda r: -len(r.text))
    rule = F.coalesce(*[F.when(r.fits(host, path), F.lit(r.text)) for r in ordered], F.lit(None).cast("string"))
    action = F.coalesce(*[F.when(F.col("rule") == r.text, F.lit(r.action)) for r in ordered], F.lit(None).cast("string"))
    scored = parts.withColumn("rule", rule).withColumn("score", F.when(F.col("rule").isNull(), model.score(host, path)))
    verdict = F.when(F.col("rule").isNotNull(), action).when(F.col("score") >= threshold, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
