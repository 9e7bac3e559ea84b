"""What Catalyst cannot say: Unicode case folding, sequence ratios, and text of HTML. All are Arrow batches."""

from __future__ import annotations

import difflib
import unicodedata
from collections import Counter
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SILENT = ("script", "style", "noscript", "template")


def normal_surface_text(name: str | None) -> str | None:
    """NFKC, one space between words, case folded."""
    return None if name is None else " ".join(unicodedata.normalize("NFKC", name).split()).casefold()


@F.pandas_udf(T.StringType())
def normal_surface(names: pd.Series) -> pd.Series:
    return names.map(normal_surface_text)


@F.pandas_udf(T.DoubleType())
def match_score(evidence: pd.Series, segment: pd.Series) -> pd.Series:
    """Half the sequence ratio (evidence first: it is not symmetric), half the Jaccard of the token sets."""
    return pd.Series([match_score_text(a, b) for a, b in zip(evidence, segment, strict=True)], dtype=float)


def match_score_text(evidence: str | None, segment: str | None) -> float:
    a, b = (evidence or "").lower(), (segment or "").lower()
    if not a or not b:
        return 0.0
    return 0.5 * difflib.SequenceMatcher(None, a, b).ratio() + 0.5 * _jaccard(_words(a), _words(b))


def _words(text: str) -> set[str]:
    return set("".join(c if c.isascii() and c.isalnum() else " " for c in text).split())


def _jaccard(x: set[str], y: set[str]) -> float:
    return len(x & y) / len(x | y) if x and y else 0.0


class BestMatch:
    """Which of some texts has the greatest match_score_text with an evidence; of equals the first. Most are left out unscored:
    a ratio cannot exceed that of the common characters, and equal texts have the greatest score there is."""

    def __init__(self, texts: list[str | None]) -> None:
        self.texts = [(t or "").lower() for t in texts]
        self.words, self.counts, self.matchers, self.known, self.first = {}, {}, {}, {}, {}
        for i, t in enumerate(self.texts):
            self.first.setdefault(t, i)

    def _ratio(self, a: str, i: int) -> float:
        if i not in self.matchers:
            self.matchers[i] = difflib.SequenceMatcher(None, "", self.texts[i])
        self.matchers[i].set_seq1(a)
        return self.matchers[i].ratio()

    def _find(self, a: str) -> tuple[float, int]:
        if not a:
            return 0.0, 0
        words, counts = _words(a), Counter(a)
        # where every character is frequent in a long text, SequenceMatcher matches none
        if a in self.first and words and (len(a) < 200 or min(counts.values()) <= len(a) // 100 + 1):
            return 1.0, self.first[a]
        bounds = []
        for b, i in self.first.items():
            if i not in self.words:
                self.words[i], self.counts[i] = _words(b), Counter(b)
            jaccard = _jaccard(words, self.words[i])
            common = sum(min(n, self.counts[i][c]) for c, n in counts.items())
            bounds.append((-(0.5 * (2.0 * common / (len(a) + len(b))) + 0.5 * jaccard) if b else 0.0, i, jaccard))
        best, at = -1.0, -1
        for bound, i, jaccard in sorted(bounds):
            if -bound < best or (-bound == best and i > at):
                continue
            score = 0.5 * self._ratio(a, i) + 0.5 * jaccard if self.texts[i] else 0.0
            if score > best or (score == best and i < at):
                best, at = score, i
        return best, at

    def of(self, evidence: str | None) -> tuple[float, int]:
        """(score, place) of the best text."""
        a = (evidence or "").lower()
        if a not in self.known:
            self.known[a] = self._find(a)
        return self.known[a]


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.parts: list[str] = []
        self.silent = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.silent += tag in _SILENT

    def handle_endtag(self, tag: str) -> None:
        if tag in _SILENT and self.silent:
            self.silent -= 1

    def handle_data(self, data: str) -> None:
        if not self.silent and data.strip():
            self.parts.append(data.strip())


def html_text(html: str | None) -> str:
    parser = _Text()
    parser.feed(html or "")
    parser.close()
    return "\n".join(parser.parts)


@F.pandas_udf(T.StringType())
def html_to_text(html: pd.Series) -> pd.Series:
    """Visible text nodes, a line each; scripts, styles and templates say nothing."""
    return html.map(html_text)
