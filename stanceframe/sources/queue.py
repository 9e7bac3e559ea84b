"""A durable queue for the driver: idempotent keys, leases that expire, retries. Spark's checkpoints do this for streams."""

from __future__ import annotations

import json
import sqlite3
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from ..schemas import JOB_STATUSES


@dataclass(frozen=True)
class Job:
    id: str
    key: str
    payload: dict
    status: str
    attempts: int


class LeaseQueue:
    """Jobs in SQLite (in memory without a path). A key is known forever: its second payload is not taken."""

    def __init__(self, path: str = ":memory:", clock: Callable[[], float] = time.time):
        self.db, self.clock = sqlite3.connect(path, isolation_level=None), clock
        self.db.execute("CREATE TABLE IF NOT EXISTS jobs (seq INTEGER PRIMARY KEY AUTOINCREMENT, id TEXT UNIQUE, key TEXT UNIQUE, payload TEXT, status TEXT, attempts INTEGER, lease_until REAL)")

    def _one(self, where: str, *values: object) -> Job | None:
        row = self.db.execute(f"SELECT id, key, payload, status, attempts FROM jobs WHERE {where}", values).fetchone()
        return Job(row[0], row[1], json.loads(row[2]), *row[3:]) if row else None

    def enqueue(self, payload: dict, key: str | None = None) -> Job:
        key = key or payload.get("guid")
        if not key:
            raise ValueError("a job needs a key or a guid")
        self.db.execute("INSERT OR IGNORE INTO jobs (id, key, payload, status, attempts) VALUES (?, ?, ?, 'queued', 0)", (uuid.uuid4().hex, key, json.dumps(payload)))
        return self._one("key = ?", key)

    def lease(self, seconds: float = 300.0) -> Job | None:
        """The oldest job that is queued or whose lease has run out."""
        now = self.clock()
        row = self.db.execute("UPDATE jobs SET status = 'leased', attempts = attempts + 1, lease_until = ? WHERE seq = (SELECT min(seq) FROM jobs WHERE status = 'queued' OR (status = 'leased' AND lease_until <= ?)) RETURNING id", (now + seconds, now)).fetchone()
        return self.get(row[0]) if row else None

    def get(self, job_id: str) -> Job | None:
        return self._one("id = ?", job_id)

    def _set(self, job_id: str, status: str) -> None:
        if not self.db.execute("UPDATE jobs SET status = ?, lease_until = NULL WHERE id = ?", (status, job_id)).rowcount:
            raise KeyError(job_id)

    def ack(self, job_id: str) -> None:
        self._set(job_id, "done")

    def nack(self, job_id: str, requeue: bool = True) -> None:
        self._set(job_id, "queued" if requeue else "failed")

    def stats(self) -> dict[str, int]:
        return dict.fromkeys(JOB_STATUSES, 0) | dict(self.db.execute("SELECT status, count(*) FROM jobs GROUP BY status").fetchall())
