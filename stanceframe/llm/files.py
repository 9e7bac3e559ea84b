"""Files that executors write to, and read from, the shared folder."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyarrow import fs


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI (local, file://, hdfs://, s3://) and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@contextmanager
def written_whole(path: str):
    """A stream whose file appears under ``path`` only when all of it is written; an attempt that dies leaves none there."""
    store, place = open_store(path)
    store.create_dir(place.rpartition("/")[0], recursive=True)
    attempt = f"{place}.{uuid.uuid4().hex}.part"
    with store.open_output_stream(attempt) as out:
        yield out
    store.move(attempt, place)


def write_bytes(path: str, data: bytes) -> None:
    with written_whole(path) as out:
        out.write(data)


def read_range(path: str, start: int, length: int | None = None) -> bytes:
    store, place = open_store(path)
    with store.open_input_file(place) as file:
        return file.read_at(file.size() - start if length is None else length, start)


def list_names(path: str) -> list[str]:
    """Names of the files of a folder; none where it does not exist."""
    store, place = open_store(path)
    return [f.base_name for f in store.get_file_info(fs.FileSelector(place, allow_not_found=True)) if f.is_file]
