"""SentencePiece BPE encoding by vectorised merge rounds, and decoding.

No piece of a vocabulary that splits by white space joins a space to what precedes it, and a character outside the
vocabulary joins nothing, so texts fall apart into words that merge on their own. The distinct words of a batch lie in
one flat array of symbols. Each round looks up all neighbouring pairs at once, takes the minimum rank per word by a
segmented reduction, merges its leftmost occurrences in all words simultaneously, and compacts the array, until no pair
is left. Where a merged piece could itself join at a better rank than the one just used, a round merges only the first
occurrence in that word, which keeps the library's order. Words of more than ``LONG`` characters are merged by a heap,
in the same order, because rounds would be quadratic there. A worker remembers the words it has encoded.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_column
from .tokens import Recent

SPACE = "▁"
LONG = 256
CACHE_WORDS = 400_000  # of each of two generations
_WORD = re.compile(r" *[^ \n]+|\n| +")
_NONE = np.int64(1 << 40)


class MergeEncoder:
    """Encodes and decodes exactly as the library does with a BPE model of identity normalisation and byte fallback."""

    _made: dict[str, MergeEncoder] = {}

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        spec = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or spec.name != "identity" or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("needs a BPE model with identity normalisation")
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.dummy = spec.add_dummy_prefix
        normal = {p.piece: i for i, p in enumerate(model.pieces) if p.type == 1}
        if any(SPACE in p.lstrip(SPACE) for p in normal):
            raise ValueError("a piece joins a space to what precedes it")
        scores = {i: model.pieces[i].score for i in normal.values()}
        self.bytes_at = self.library.piece_to_id("<0x00>")
        # ranks: the better the score the smaller; equal scores share a rank and the leftmost goes first
        order = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        self.chars = {p: i for p, i in normal.items() if len(p) == 1}
        self.n = len(model.pieces)
        pairs, unsafe_from = {}, {}
        for piece, i in normal.items():
            for k in range(1, len(piece)):
                a, b = normal.get(piece[:k]), normal.get(piece[k:])
                if a is not None and b is not None:
                    pairs[a * self.n + b] = (order[scores[i]], i)
                    for part in (a, b):
                        unsafe_from[part] = min(unsafe_from.get(part, 1 << 40), order[scores[i]])
        keys = np.array(sorted(pairs), np.int64)
        self.keys = np.append(keys, np.iinfo(np.int64).max)
        self.ranks = np.append(np.array([pairs[k][0] for k in keys.tolist()], np.int64), _NONE)
        self.into = np.append(np.array([pairs[k][1] for k in keys.tolist()], np.int64), -1)
        self.pairs = pairs
        self.safe = np.ones(self.n, bool)
        for part, rank in unsafe_from.items():
            self.safe[part] = rank > order[scores[part]]
        self.recent = Recent(CACHE_WORDS)

    @classmethod
    def of(cls, path: str) -> MergeEncoder:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.n + right
        at = np.searchsorted(self.keys, key)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), at, len(self.keys) - 1)

    def merge_words(self, words: list[str]) -> list[tuple[int, ...]]:
        """The ids of each word (spaces already ``SPACE``), by merge rounds."""
        out: list = [None] * len(words)
        short = [i for i, w in enumerate(words) if len(w) <= LONG]
        for i, w in enumerate(words):
            if len(w) > LONG:
                out[i] = self._spell(self._heap([self.chars.get(c, -1) for c in w]), w)
        if not short:
            return out
        flat = "".join(words[i] for i in short)
        chars = self.chars
        known = {c: chars.get(c, -1) for c in set(flat)}
        symbols = np.fromiter(map(known.__getitem__, flat), np.int64, len(flat))
        sizes = np.array([len(words[i]) for i in short])
        owner = np.repeat(np.arange(len(short)), sizes)
        place = np.arange(len(flat))  # where the symbol begins in flat
        done_at, done_id = [], []
        while len(symbols):
            pair = np.full(len(symbols), len(self.keys) - 1)
            if len(symbols) > 1:
                same = owner[1:] == owner[:-1]
                pair[:-1] = np.where(same, self._lookup(symbols[:-1], symbols[1:]), len(self.keys) - 1)
            rank = self.ranks[pair]
            heads = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            best = np.minimum.reduceat(rank, heads)
            length = np.diff(np.r_[heads, len(symbols)])
            open_word = np.repeat(best < _NONE, length)
            done_at.append(place[~open_word])
            done_id.append(symbols[~open_word])
            if not open_word.any():
                break
            hit = (rank == np.repeat(best, length)) & open_word
            at = np.flatnonzero(hit)
            # one rank may stand for several pieces of equal score, and a safe piece for all its occurrences
            first = np.r_[True, owner[at[1:]] != owner[at[:-1]]]
            group = np.cumsum(first) - 1
            lead = pair[at[first]][group]
            take = first | ((pair[at] == lead) & self.safe[self.into[pair[at]]] & self._plain(pair[at], at, group))
            # of overlapping occurrences (a a a) every second one counts from the left
            run_start = np.r_[True, (at[1:] != at[:-1] + 1)]
            since = at - at[run_start][np.cumsum(run_start) - 1]
            at = at[take & (since % 2 == 0)]
            symbols[at] = self.into[pair[at]]
            stay = open_word.copy()
            stay[at + 1] = False
            symbols, owner, place = symbols[stay], owner[stay], place[stay]
        at, ids = np.concatenate(done_at), np.concatenate(done_id)
        order = np.argsort(at, kind="stable")
        at, ids = at[order], ids[order]
        bounds = np.searchsorted(at, np.cumsum(sizes)).tolist()
        ids_list, at_list, start = ids.tolist(), at.tolist(), 0
        for i, stop in zip(short, bounds, strict=True):
            part = ids_list[start:stop]
            if -1 in part:
                part = [y for x, p in zip(part, at_list[start:stop], strict=True) for y in ((x,) if x >= 0 else self._bytes(flat[p]))]
            out[i] = tuple(part)
            start = stop
        return out

    @staticmethod
    def _plain(pair: np.ndarray, at: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Whether all occurrences at the minimum rank in the word are of one pair."""
        mixed = np.zeros(group[-1] + 1, bool)
        first = np.r_[True, group[1:] != group[:-1]]
        np.logical_or.at(mixed, group, pair != pair[first][group])
        return ~mixed[group]

    def _bytes(self, char: str) -> tuple[int, ...]:
        return tuple(self.bytes_at + b for b in char.encode())

    def _spell(self, merged: list[tuple[int, int]], word: str) -> tuple[int, ...]:
        return tuple(y for symbol, p in merged for y in ((symbol,) if symbol >= 0 else self._bytes(word[p])))

    def _heap(self, symbols: list[int]) -> list[tuple[int, int]]:
        """Merge one long word: (symbol, where it begins)."""
        n, pairs = len(symbols), self.pairs
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap: list[tuple[int, int, int, int, int]] = []

        def push(i: int, j: int) -> None:
            if 0 <= i and j < n and symbols[i] >= 0 and symbols[j] >= 0 and (found := pairs.get(symbols[i] * self.n + symbols[j])):
                heapq.heappush(heap, (found[0], i, found[1], symbols[i], symbols[j]))

        for i in range(n - 1):
            push(i, i + 1)
        while heap:
            _, i, into, a, b = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if not alive[i] or j >= n or symbols[i] != a or symbols[j] != b:
                continue
            symbols[i], alive[j], after[i] = into, False, after[j]
            if after[j] < n:
                before[after[j]] = i
            push(before[i], i)
            push(i, after[i])
        return [(symbols[i], i) for i in range(n) if alive[i]]

    def words_of(self, text: str) -> list[str]:
        """``text`` cut into words that begin with their space."""
        text = text.replace(SPACE, " ")
        return _WORD.findall(" " + text if self.dummy and text else text)

    def learn(self, words: set[str]) -> dict[str, tuple[tuple[int, ...], bytes]]:
        """Encode the words that the cache lacks: word -> (ids, the same in decimal)."""
        missing = self.recent.missing(words)
        for at in range(0, len(missing), 20_000):
            part = missing[at : at + 20_000]
            for word, ids in zip(part, self.merge_words([w.replace(" ", SPACE) for w in part]), strict=True):
                self.recent.fresh[word] = ids, ",".join(map(str, ids)).encode()
        return self.recent.fresh

    def encode(self, texts: list[str]) -> list[list[int]]:
        words = [self.words_of(t) for t in texts]
        known = self.learn(set().union(*words))
        return [[i for w in part for i in known[w][0]] for part in words]

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.library.decode(ids)


def encode_documents(docs: DataFrame, model: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, ids (array<int>). Null text is empty and has no ids; other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = MergeEncoder.of(model)
        for batch in slices(batches):
            yield pa.record_batch({"doc_id": batch.column(0), "ids": pa.array(encoder.encode(text_column(batch)), pa.list_(pa.int32()))})

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id bigint, ids array<int>")


def round_trip(docs: DataFrame, model: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, then decode, whole documents: doc_id, n_tokens, ids_sha256 (decimal ids joined by commas), decoded_sha256.

    One row per input row, repeated ones too; a null identifier stays null. Null text is empty: no ids, empty text. Other
    columns of ``docs`` are not read. An empty table gives no rows. Nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, sha = MergeEncoder.of(model), hashlib.sha256
        for batch in slices(batches):
            words = [encoder.words_of(t) for t in text_column(batch)]
            known = encoder.learn(set().union(*words)).__getitem__
            found = [[*map(known, part)] for part in words]
            ids = [[i for w in part for i in w[0]] for part in found]
            spelled = [sha(b",".join([w[1] for w in part])).hexdigest() for part in found]
            decoded = [sha(t.encode()).hexdigest() for t in encoder.decode(ids)]
            yield pa.record_batch({"doc_id": batch.column(0), "n_tokens": pa.array([len(x) for x in ids], pa.int64()), "ids_sha256": spelled, "decoded_sha256": decoded})

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
