"""Token ids in binary shards: every document is compressed alone with a shared zstandard dictionary.

A shard holds, in ascending document order, ``MAGIC``, the frames, then an index (identifier, null flag, offset, number of
ids of each document), and a footer with the place of the index, the number of documents, the width of an id and the
SHA-256 of the dictionary. One document is read by its index entry and one frame. The dictionary lies beside the shards,
named by its hash; it is trained on pieces of id arrays of a bounded sample of all rows and only affects sizes.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, new_path, slices, text_column
from .files import open_store, read_range, write_bytes, written_whole
from .tokens import ChunkEncoder

MAGIC = b"SFTOKZ01"
_FOOTER = "<QQQ32s8s"
#: Documents, and pieces of their id arrays of so many bytes, that the dictionary is trained on, at most; its size in bytes.
SAMPLE_DOCS, SAMPLE_PIECES, PIECE_BYTES, DICTIONARY_BYTES = 1000, 1000, 16 << 10, 64 << 10
#: Compressed bytes of a shard, about.
SHARD_BYTES = 64 << 20
_ENTRY = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("offset", "<u8"), ("n", "<u8")])


def train_dictionary(arrays: list[bytes]) -> bytes:
    """A dictionary for serialized id arrays; empty where there is too little to learn from."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, arrays).as_bytes() if len(arrays) >= 16 else b""
    except zstandard.ZstdError:
        return b""


def _sample(docs: DataFrame, tokenizer: str, cut: str, width: int) -> list[bytes]:
    """Pieces of serialized id arrays: of the documents whose identifiers hash lowest, the pieces that do."""
    ids = docs.where("doc_id is not null").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS).distinct()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ChunkEncoder.of(tokenizer, cut)
        for batch in slices(batches):
            for raw in encoder.encode(text_column(batch)):
                data = np.frombuffer(raw, "<u4").astype(f"<u{width}").tobytes()
                yield pa.record_batch({"piece": pa.array([data[i : i + PIECE_BYTES] for i in range(0, len(data), PIECE_BYTES)], pa.binary())})

    # ``SAMPLE_DOCS`` bounds the identifiers that are sent
    found = docs.join(F.broadcast(ids), "doc_id", "left_semi").select("text").mapInArrow(pieces, "piece binary")
    return found.orderBy(F.xxhash64("piece"), "piece").limit(SAMPLE_PIECES).toArrow()["piece"].to_pylist()


def _dictionary(raw: bytes) -> dict:
    return {"dict_data": zstandard.ZstdCompressionDict(raw)} if raw else {}


def _frames(docs: DataFrame, tokenizer: str, cut: str, end_id: int, width: int, dictionary: bytes) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, press, row = ChunkEncoder.of(tokenizer, cut), zstandard.ZstdCompressor(level=3, **_dictionary(dictionary)), TaskContext.get().partitionId() << 40
        end = np.array([end_id], "<u4").tobytes()
        for batch in slices(batches):
            ids = [x + end for x in encoder.encode(text_column(batch))]
            frames = [press.compress(np.frombuffer(x, "<u4").astype(f"<u{width}").tobytes()) for x in ids]
            yield pa.record_batch({"doc_id": batch.column(0), "row": np.arange(row, row + len(ids)), "n": [len(x) // 4 for x in ids], "frame": pa.array(frames, pa.binary())})
            row += len(ids)

    return docs.mapInArrow(run, "doc_id bigint, row bigint, n bigint, frame binary")


def write_token_files(docs: DataFrame, path: str, tokenizer: str, *, cut: str = "leading", end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Encode whole documents, end each with ``end_id``, write shards under ``path``; returns (shard, path, n_docs, n_ids).

    Null text is empty (its end id alone). Rows come in ascending identifier order, null first; repeated identifiers keep
    all their rows, in input order. Other columns are not read. An empty table writes no shard. A shard appears only when
    whole, and a task that runs again writes the same one.
    """
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    encoder = ChunkEncoder.of(tokenizer, cut)
    width = 2 if encoder.library.get_vocab_size(True) <= 1 << 16 and end_id < 1 << 16 else 4
    dictionary = train_dictionary(_sample(docs, tokenizer, cut, width))
    hashed = hashlib.sha256(dictionary).digest()
    write_bytes(f"{path}/{hashed.hex()}.zdict", dictionary)

    frames = materialize(_frames(docs, tokenizer, cut, end_id, width, dictionary), "token-frames", compression="none")
    total = frames.agg(F.sum(F.length("frame"))).first()[0] or 0
    shards = max(1, -(-total // shard_bytes), min(total >> 20, docs.sparkSession.sparkContext.defaultParallelism))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, index, place, n_ids = TaskContext.get().partitionId(), [], len(MAGIC), 0
        name = f"{path}/shard-{shard:08d}.ztok"
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        with written_whole(name) as out:
            out.write(MAGIC)
            while first is not None:
                lengths = np.asarray(pa.compute.binary_length(first.column(2))).astype(np.uint64)
                out.write(b"".join(first.column(2).to_pylist()))
                part = np.zeros(first.num_rows, _ENTRY)
                ids = first.column(0)
                part["doc_id"], part["null"] = ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)
                part["offset"], part["n"] = place + np.cumsum(lengths) - lengths, first.column(1).to_numpy()
                place, n_ids = place + int(lengths.sum()), n_ids + int(part["n"].sum())
                index.append(part)
                first = next((b for b in batches if b.num_rows), None)
            table = np.concatenate(index)
            out.write(table.tobytes())
            out.write(struct.pack(_FOOTER, place, len(table), width, hashed, MAGIC))
        yield pa.record_batch({"shard": pa.array([shard], pa.int64()), "path": [name], "n_docs": pa.array([len(table)], pa.int64()), "n_ids": pa.array([n_ids], pa.int64())})

    ordered = frames.repartitionByRange(shards, "doc_id", "row").sortWithinPartitions("doc_id", "row").select("doc_id", "n", "frame")
    return materialize(ordered.mapInArrow(run, "shard bigint, path string, n_docs bigint, n_ids bigint"), "token-shards")


class Shard:
    """Random access to one shard."""

    def __init__(self, path: str):
        store, place = open_store(path)
        self.file = store.open_input_file(place)
        size, tail = self.file.size(), struct.calcsize(_FOOTER)
        self.end, n, self.width, hashed, magic = struct.unpack(_FOOTER, self.file.read_at(tail, size - tail))
        if magic != MAGIC or self.file.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError(f"{path} is not a token shard")
        self.index = np.frombuffer(self.file.read_at(n * _ENTRY.itemsize, self.end), _ENTRY)
        raw = read_range(f"{path.rpartition('/')[0]}/{hashed.hex()}.zdict", 0)
        if hashlib.sha256(raw).digest() != hashed:
            raise ValueError(f"the dictionary of {path} has changed")
        self.press = zstandard.ZstdDecompressor(**_dictionary(raw))

    def frames(self, chunk: int = 8 << 20) -> Iterator[tuple[int, np.ndarray]]:
        """(place in the index, ids) of every document, reading the shard in pieces."""
        ends = np.append(self.index["offset"][1:], np.uint64(self.end)) if len(self.index) else self.index["offset"]
        at = 0
        while at < len(self.index):
            base = int(self.index["offset"][at])
            stop = max(at + 1, int(np.searchsorted(ends, base + chunk, side="right")))
            data = self.file.read_at(int(ends[stop - 1]) - base, base)
            for i in range(at, stop):
                yield i, self._ids(data[int(self.index["offset"][i]) - base : int(ends[i]) - base])
            at = stop

    def _ids(self, frame: bytes) -> np.ndarray:
        return np.frombuffer(self.press.decompress(frame), f"<u{self.width}")

    def document(self, doc_id: int) -> list[np.ndarray]:
        """The id arrays of one identifier, reading only their frames."""
        index = self.index[self.index["null"] == 0]
        skip = len(self.index) - len(index)
        lo, hi = (int(np.searchsorted(index["doc_id"], doc_id, side=s)) + skip for s in ("left", "right"))
        ends = np.append(self.index["offset"][1:], np.uint64(self.end)).tolist()
        return [self._ids(self.file.read_at(ends[i] - int(self.index["offset"][i]), int(self.index["offset"][i]))) for i in range(lo, hi)]


def read_token_files(shards: DataFrame) -> DataFrame:
    """Every document of written shards: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = shards.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0))).select("path", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard = Shard(path)
                n = shard.index["n"].astype(np.int64)
                crc = np.zeros(len(n), np.int64)
                for i, ids in shard.frames():
                    if len(ids) != n[i]:
                        raise ValueError(f"{path}: document {i} has {len(ids)} ids, its index says {n[i]}")
                    crc[i] = zlib.crc32(ids.astype("<u4").tobytes())
                starts = start + np.cumsum(n) - n
                for a in range(0, len(n), 50_000):
                    b = slice(a, a + 50_000)
                    ids = pa.array(shard.index["doc_id"][b], mask=shard.index["null"][b].astype(bool))
                    yield pa.record_batch({"doc_id": ids, "start": starts[b], "n_tokens": n[b], "ids_crc32": crc[b]})

    n = shards.count()
    return placed.repartition(max(1, n), "path").mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def write_and_read(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Write ``docs`` to a new folder in shared storage and read the files back."""
    return read_token_files(write_token_files(docs, new_path(docs.sparkSession, "token-files"), tokenizer, **options))
