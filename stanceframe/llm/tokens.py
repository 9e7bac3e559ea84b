"""Ids of the `tokenizers` library at the speed of a lookup: texts are cut where the vocabulary never joins."""

from __future__ import annotations

import os
import struct
from collections.abc import Iterable

import numpy as np

#: Distinct chunks of a generation of the cache; a worker remembers two generations.
CACHE_CHUNKS = 400_000
#: Marks the first chunk of a text, which no space precedes.
_FIRST = "\x02"
_LATIN = frozenset(c for i in (*range(65, 91), *range(97, 123), *range(0xC0, 0x100)) if (c := chr(i)).isalpha())


class Recent:
    """A dictionary of two generations: ``fresh`` holds what was asked for lately, ``old`` what was before."""

    def __init__(self, most: int):
        self.most, self.fresh, self.old = most, {}, {}

    def missing(self, keys: set) -> list:
        """Make ``fresh`` ready for ``keys``; those that must still be put in."""
        if len(self.fresh) > self.most:
            self.fresh, self.old = {}, self.fresh
        lacking = keys.difference(self.fresh)
        if self.old:
            known = lacking.intersection(self.old)
            self.fresh.update((k, self.old[k]) for k in known)
            lacking -= known
        return list(lacking)


class ChunkEncoder:
    """Encodes with a ``tokenizers`` file (``add_special_tokens=False``), remembering the ids of each chunk.

    ``cut`` is ``"word"`` for vocabularies that drop white space and ``"leading"`` for byte-level ones; a text with runs of
    white space, or with the mark of a first chunk in it, goes to the library whole. ``ordinary``: the strings of special tokens are ordinary text.
    """

    _made: dict[tuple, ChunkEncoder] = {}

    def __init__(self, path: str, cut: str, ordinary: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = ordinary
        self.cut, self.recent = cut, Recent(CACHE_CHUNKS)
        # new chunks are encoded many at a time, with something between them that joins neither side
        special = next(iter(self.library.get_added_tokens_decoder().values())).content
        self.between = "\n" if cut == "leading" else None if ordinary else special
        self.model = self.library.model
        spell = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.spelled = {ord(c): spell(c)[0][0] for c in _LATIN}
        self.tails = {t: np.array(self.library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in ".,"}
        self.line_end = np.array(self.library.encode("\n", add_special_tokens=False).ids, "<u4").tobytes()
        if self.between:
            (self.between_id,) = self.library.encode(self.between, add_special_tokens=False).ids

    @classmethod
    def of(cls, path: str, cut: str, ordinary: bool = False) -> ChunkEncoder:
        key = (path, cut, ordinary)
        if key not in cls._made:
            cls._made[key] = cls(*key)
        return cls._made[key]

    def _chunks(self, text: str) -> list[str]:
        """Keys of the pieces of a text.

        A byte-level vocabulary attaches one space to what follows, so such a text is cut before spaces and line ends: a
        key stands for itself with a space before it, with ``_FIRST`` for the first piece, with a line end for itself.
        """
        if self.cut == "word":
            return text.replace("\n", " ").split(" ")
        return f"{_FIRST}{text}".replace("\n", " \n").split(" ")

    def _piece(self, key: str) -> str:
        if self.cut == "word" or key[0] == "\n":
            return key
        return key[1:] if key[0] == _FIRST else f" {key}"

    def _uncut(self, key: str) -> bool:
        """Whether white space stands beside a cut, so that the text must go to the library whole."""
        if self.cut == "word":
            return False
        body = key[1:] if key[:1] in ("\n", _FIRST) else key
        return key[:1] != _FIRST and not body or _FIRST in body or body.split() != [body] and bool(body)

    def _plain(self, key: str) -> bytes | None:
        """The ids of ASCII and Latin-1 letters, perhaps with a stop behind, straight from the library's merges.

        Such a piece is one stretch for the vocabulary's pattern and one for the stop, and no normal form changes it.
        """
        tail = self.tails.get(key[-1])
        word = key[:-1] if tail else key
        lead = word[:1] if self.cut == "leading" and word[:1] in ("\n", _FIRST) else ""
        letters = word[1:] if lead else word
        ascii_only = letters.isascii()
        if not (letters.isalpha() if ascii_only else _LATIN.issuperset(letters)):
            return None
        if self.cut == "word":
            letters = word = letters.lower()
        found = self.recent.fresh.get(word) or self.recent.old.get(word)
        if found is None:
            if not ascii_only:
                letters = letters.translate(self.spelled)
            ids = [t.id for t in self.model.tokenize(letters if lead or self.cut == "word" else f"Ġ{letters}")]
            found = self.recent.fresh[word] = (self.line_end if lead == "\n" else b"") + struct.pack(f"<{len(ids)}I", *ids)
        return found + tail if tail else found

    def _many(self, chunks: list[str]) -> Iterable[bytes]:
        # a piece that begins or ends in white space could join what stands between
        if self.between and len(chunks) > 1 and not any("\n" in c for c in chunks):
            ids = np.array(self.library.encode(self.between.join(chunks), add_special_tokens=False).ids, "<u4")
            cuts = np.flatnonzero(ids == self.between_id)
            if len(cuts) == len(chunks) - 1:
                raw, ends = ids.tobytes(), (4 * np.append(cuts, len(ids))).tolist()
                starts = [0, *(e + 4 for e in ends[:-1])]
                return [raw[a:b] for a, b in zip(starts, ends, strict=True)]
        return [np.array(g.ids, "<u4").tobytes() for g in self.library.encode_batch(chunks, add_special_tokens=False)]

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        texts = list(texts)
        # a text that holds the mark could spell the key of a first piece
        marked = {i: self._library(t) for i, t in enumerate(texts) if _FIRST in t} if self.cut == "leading" else {}
        chunks = [[] if i in marked else self._chunks(t) for i, t in enumerate(texts)]
        lacking = self.recent.missing(set().union(*chunks))
        cache, whole, rest, long = self.recent.fresh, set(), [], []
        for key in lacking:
            if key and len(key) <= 64 and (ids := self._plain(key)) is not None:
                cache[key] = ids
            elif self._uncut(key):
                whole.add(key)
            elif not key:
                cache[key] = b""
            elif len(key) > 64:  # would fill the cache with what never comes again
                long.append(key)
            else:
                rest.append(key)
        for at in range(0, len(rest), 256):
            part = rest[at : at + 256]
            cache.update(zip(part, self._many([self._piece(k) for k in part]), strict=True))
        alone = {key: self._library(self._piece(key)) for key in long}
        look = cache.__getitem__ if not alone else lambda key: alone[key] if key in alone else cache[key]
        if not whole and not marked:
            return [b"".join(map(look, part)) for part in chunks]
        return [marked[i] if i in marked else b"".join(map(look, part)) if whole.isdisjoint(part) else self._library(text) for i, (text, part) in enumerate(zip(texts, chunks, strict=True))]

    def _library(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
