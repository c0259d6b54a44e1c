"""The queue of runs: a small table of states on the driver, safe under several workers. Results are in the result store."""

from __future__ import annotations

import sqlite3
from datetime import UTC, datetime

from gristmill.config import RunSpec
from gristmill.operators.store import new_run_id


class DuplicateRun(ValueError):
    """The same specification is waiting, running or done."""


class UnknownRun(LookupError):
    """No run has this id."""


class RunQueue:
    """States are pending, running, succeeded, failed and cancelled; only a pending run can be claimed or cancelled."""

    def __init__(self, file: str):
        self.file = file
        with self.open() as db:
            db.execute("CREATE TABLE IF NOT EXISTS runs (id TEXT PRIMARY KEY, name TEXT, spec_json TEXT, spec_hash TEXT, status TEXT, error TEXT, claimed_by TEXT, created_at TEXT, started_at TEXT, finished_at TEXT)")

    def open(self) -> sqlite3.Connection:
        return sqlite3.connect(self.file, timeout=30)

    def submit(self, spec: RunSpec, force: bool = False) -> str:
        """Queue a run; unless forced, the same specification with the same contents is refused while it waits, runs or is done."""
        spec = spec.with_digests()
        with self.open() as db:
            same = db.execute("SELECT id FROM runs WHERE spec_hash = ? AND status NOT IN ('failed', 'cancelled') ORDER BY rowid DESC", (spec.spec_hash(),)).fetchone()
            if same and not force:
                raise DuplicateRun(f"run {same[0]} has this specification")
            run_id = new_run_id()
            db.execute("INSERT INTO runs (id, name, spec_json, spec_hash, status, created_at) VALUES (?, ?, ?, ?, 'pending', ?)", (run_id, spec.name, spec.canonical_json(), spec.spec_hash(), now()))
        return run_id

    def claim(self, worker: str, run_id: str | None = None) -> dict | None:
        """Take the oldest waiting run, or a certain one if it still waits; None if there is none. One statement, so no two workers get the same."""
        chosen = "id = ? AND status = 'pending'" if run_id else "id = (SELECT id FROM runs WHERE status = 'pending' ORDER BY created_at, rowid LIMIT 1)"
        with self.open() as db:
            row = db.execute(f"UPDATE runs SET status = 'running', claimed_by = ?, started_at = ? WHERE {chosen} RETURNING id, name, spec_json", (worker, now(), *([run_id] if run_id else []))).fetchone()
        return dict(zip(("id", "name", "spec_json"), row)) if row else None

    def finish(self, run_id: str, error: str | None = None) -> None:
        with self.open() as db:
            if not db.execute("UPDATE runs SET status = ?, error = ?, finished_at = ? WHERE id = ?", ("failed" if error else "succeeded", error, now(), run_id)).rowcount:
                raise UnknownRun(run_id)

    def cancel(self, run_id: str) -> bool:
        """Whether the run was still waiting and is cancelled now."""
        with self.open() as db:
            if db.execute("SELECT 1 FROM runs WHERE id = ?", (run_id,)).fetchone() is None:
                raise UnknownRun(run_id)
            return bool(db.execute("UPDATE runs SET status = 'cancelled', finished_at = ? WHERE id = ? AND status = 'pending'", (now(), run_id)).rowcount)

    def status(self, run_id: str) -> str:
        with self.open() as db:
            row = db.execute("SELECT status FROM runs WHERE id = ?", (run_id,)).fetchone()
        if row is None:
            raise UnknownRun(run_id)
        return row[0]


def now() -> str:
    return datetime.now(UTC).isoformat(timespec="microseconds")
