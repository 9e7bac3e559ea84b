"""Vector bin packing of examples under simultaneous limits on tokens, segments and loss-bearing tokens.

Every task packs its own rows, so nothing is shuffled. Pieces wait in size classes (powers of two of each demand). The
open sequence takes, again and again, the waiting piece whose demand vector has the largest dot product with what the
sequence has left, each axis weighed by how scarce it is among the waiting pieces. Where ``cut`` is set, a piece that
would overflow the open sequence is cut at its end, so a full sequence has no padding, and what a task has left at its
end becomes sequences whose lengths are powers of two.
"""

from __future__ import annotations

import zlib
from collections import defaultdict, deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, slices, text_column
from .tokens import ChunkEncoder

#: Limits of one sequence: tokens, segments, loss-bearing tokens.
LIMITS = (4096, 256, 4096)
#: Waiting pieces of a task; beyond it the packer closes sequences.
WAITING = 2048
PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


@dataclass(slots=True)
class Piece:
    """``length`` tokens of one example; the last ``loss`` of them bear loss."""

    key: object
    start: int
    length: int
    loss: int
    data: object = None

    def split(self, at: int) -> tuple[Piece, Piece]:
        cut = None if self.data is None else (self.data[: 4 * at], self.data[4 * at :])
        tail_loss = min(self.loss, self.length - at)
        return (
            Piece(self.key, self.start, at, self.loss - tail_loss, cut and cut[0]),
            Piece(self.key, self.start + at, self.length - at, tail_loss, cut and cut[1]),
        )


class Packer:
    """Feeds pieces in, gives closed sequences (lists of pieces) out. Demands above a limit need ``cut``."""

    def __init__(self, limits: tuple[int, int, int] = LIMITS, cut: bool = False, waiting: int = WAITING):
        self.limits, self.cut, self.most = limits, cut, waiting
        self.classes: dict[tuple[int, int], deque[Piece]] = defaultdict(deque)
        self.count, self.tokens, self.loss = 0, 0, 0

    def _hold(self, piece: Piece) -> None:
        self.classes[piece.length.bit_length(), piece.loss.bit_length()].append(piece)
        self.count, self.tokens, self.loss = self.count + 1, self.tokens + piece.length, self.loss + piece.loss

    def _take(self, key: tuple[int, int]) -> Piece:
        piece = self.classes[key].popleft()
        if not self.classes[key]:
            del self.classes[key]
        self.count, self.tokens, self.loss = self.count - 1, self.tokens - piece.length, self.loss - piece.loss
        return piece

    def add(self, piece: Piece) -> Iterator[list[Piece]]:
        tokens, _, loss = self.limits
        while self.cut and (piece.length > tokens or piece.loss > loss):
            head, piece = piece.split(min(tokens, piece.length - piece.loss + loss))
            if head.length == tokens and head.loss <= loss:
                yield [head]
            else:
                self._hold(head)
        if piece.length > tokens or piece.loss > loss:
            raise ValueError(f"a piece of {piece.length} tokens, {piece.loss} with loss, exceeds {self.limits}; use cut=True")
        if piece.length:
            self._hold(piece)
        while self.count >= self.most:
            yield from self._closed()

    def close(self) -> list[Piece]:
        """One sequence from what waits."""
        left, out = list(self.limits), []
        while self.count and left[0] > 0 and left[1] > 0:
            # an axis weighs as much as the waiting pieces ask of it in capacities
            scarce = (self.tokens / self.limits[0], self.count / self.limits[1], self.loss / self.limits[2])
            best, best_score, last = None, -1.0, self.cut and left[1] == 1 and max(self.classes)[0] >= left[0].bit_length()
            for key, queue in () if last else self.classes.items():
                piece = queue[0]
                if piece.length <= left[0] and piece.loss <= left[2]:
                    score = sum(w * (d / c) * (r / c) for w, d, r, c in zip(scarce, (piece.length, 1, piece.loss), left, self.limits, strict=True))
                    if score > best_score:
                        best, best_score = key, score
            if best is None:
                if not self.cut:
                    break
                # the waiting piece of which most fits is cut; its loss-bearing end must fit too
                room = {k: min(left[0], q[0].length - q[0].loss + left[2]) for k, q in self.classes.items()}
                key = max(room, key=lambda k: (room[k], k))
                at = room[key]
                if at <= 0:
                    break
                piece = self._take(key)
                piece, rest = piece.split(at) if at < piece.length else (piece, None)
                if rest:
                    self._hold(rest)
            else:
                piece = self._take(best)
            out.append(piece)
            left = [left[0] - piece.length, left[1] - 1, left[2] - piece.loss]
        return out

    def _closed(self) -> Iterator[list[Piece]]:
        sequence = self.close()
        total = sum(p.length for p in sequence)
        if self.cut and total & (total - 1) and total < self.limits[0]:
            yield from self._powers(sequence, total)
        else:
            yield sequence

    def finish(self) -> Iterator[list[Piece]]:
        while self.count:
            yield from self._closed()

    @staticmethod
    def _powers(pieces: list[Piece], total: int) -> Iterator[list[Piece]]:
        """Sequences of descending powers of two, which need no padding."""
        queue = deque(pieces)
        for bit in range(total.bit_length() - 1, -1, -1):
            need, out = total & (1 << bit), []
            while need:
                piece = queue.popleft()
                if piece.length > need:
                    piece, rest = piece.split(need)
                    queue.appendleft(rest)
                out.append(piece)
                need -= piece.length
            if out:
                yield out


def pack_examples(examples: Iterable[tuple[object, int, int]], limits: tuple[int, int, int] = LIMITS, cut: bool = False, waiting: int = WAITING) -> Iterator[list[Piece]]:
    """Pack (key, tokens, loss-bearing tokens); examples without tokens take no place."""
    packer = Packer(limits, cut, waiting)
    for key, tokens, loss in examples:
        yield from packer.add(Piece(key, 0, tokens, loss))
    yield from packer.finish()


def pack_frame(examples: DataFrame, *, id_col: str, tokens_col: str, loss_col: str, limits: tuple[int, int, int] = LIMITS, cut: bool = False) -> DataFrame:
    """Pack rows that already have their counts (instruction data): one row per piece with sequence_id and offset.

    Null counts are 0; loss-bearing tokens beyond the tokens count as all of them. A row above a limit stops the job unless
    ``cut`` is set. Other columns are not read. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        yield from _emit(pack_examples(((k, t, max(0, min(t, m))) for k, t, m in rows), limits, cut), with_ids=False)

    counts = [F.coalesce(F.col(c), F.lit(0)).cast("bigint") for c in (tokens_col, loss_col)]
    return examples.select(F.col(id_col).cast("bigint"), *counts).mapInArrow(run, "doc_id bigint, start bigint, length bigint, loss bigint, sequence_id bigint, offset bigint")


def _emit(sequences: Iterable[list[Piece]], with_ids: bool, doc_tokens: dict | None = None) -> Iterator[pa.RecordBatch]:
    first, rows = TaskContext.get().partitionId() << 40, []
    names = ["doc_id", "start", "length", *(["ids_crc32", "doc_tokens"] if with_ids else ["loss"]), "sequence_id", "offset"]

    def batch() -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)

    for n, sequence in enumerate(sequences):
        offset = 0
        for p in sequence:
            key, extra = (p.key[0], (zlib.crc32(p.data), p.key[1])) if with_ids else (p.key, (p.loss,))
            rows.append((key, p.start, p.length, *extra, first + n, offset))
            offset += p.length
        if len(rows) >= 8192:
            yield batch()
            rows.clear()
    if rows:
        yield batch()


def pack_documents(docs: DataFrame, tokenizer: str, *, cut: str = "word", end_id: int = 2, limits: tuple[int, int, int] = LIMITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenize whole documents, end each with ``end_id``, and pack them, cutting freely: one row per piece.

    Every token bears loss here. Null text is empty: such a document is its end id alone. Repeated rows are packed once
    each; a null identifier stays null. Other columns of ``docs`` are not read. An empty table gives no rows.
    Sequence numbers come from the input partition and the order in it, so a task that runs again gives the same ones.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer, end = ChunkEncoder.of(tokenizer, cut), Packer(limits, cut=True), np.array([end_id], "<u4").tobytes()

        def sequences() -> Iterator[list[Piece]]:
            for whole in batches:
                for batch in slices(iter([whole])):
                    for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode(text_column(batch)), strict=True):
                        n = len(ids) // 4 + 1
                        yield from packer.add(Piece((doc_id, n), 0, n, n, ids + end))
                release()
            yield from packer.finish()

        yield from _emit(sequences(), with_ids=True)

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, PIECES)
