"""A job is published when all its files are settled, or when it stalls.

State is kept per job: which files came, which are settled, when something last happened,
and whether the job has ended. The rules are a fold over the job's deliveries in order of
time, with its deadline falling between two deliveries, so the result does not depend on
how deliveries are cut into batches, as long as they are not later than the watermark.

* A file settles once, by its first result or failure; redelivery changes nothing.
* The last file to settle ends the job: ``published`` with at least one result, else
  ``failed``.
* No delivery for the grace period: files that never came are settled as failed. If files
  came without a result, their extraction is asked for again (``redrive``), and the grace
  period starts anew; the fourth time, the job fails. Otherwise what worked is published.
* A job of which no file came at all fails after the longer grace period for uploads.
* What is delivered after the end is ``ignored``.

``clock="event"`` measures the grace period on the watermark, so a replay gives the same
rows. ``clock="processing"`` measures it on the wall clock, as a live service would.
State of an ended job is dropped after ``keep``; a delivery still later starts a new job.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple, dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from passbook.streaming.intake import KINDS

MINUTE = 60_000
UPLOAD_GRACE, PROCESS_GRACE, KEEP = 60 * MINUTE, 20 * MINUTE, 7 * 24 * 60 * MINUTE
MOST_REDRIVES = 3
ACTIONS = "job_id long, action string, at timestamp, n_ok int, n_failed int, redrives int, files array<int>"
STATE = "expected int, ok array<int>, bad array<int>, came array<int>, last long, redrives int, ended string"


@dataclass
class Job:
    expected: int = 0
    ok: list[int] = field(default_factory=list)
    bad: list[int] = field(default_factory=list)
    came: list[int] = field(default_factory=list)
    last: int = 0
    redrives: int = 0
    ended: str = ""

    def deadline(self) -> int:
        return self.last + (PROCESS_GRACE if self.came else UPLOAD_GRACE)

    def _row(self, action: str, at: int, files: list[int] | None = None) -> tuple:
        return action, at, len(self.ok), len(self.bad), self.redrives, sorted(files if files is not None else self.ok)

    def _end(self, how: str, at: int) -> tuple:
        self.ended, self.last = how, at
        return self._row(how, at)

    def stall(self) -> tuple:
        """What the passing of the deadline does."""
        at = self.deadline()
        if not self.came:
            return self._end("failed", at)
        settled = {*self.ok, *self.bad}
        waiting = [i for i in range(self.expected) if i not in settled]
        lost = [i for i in waiting if i in self.came]
        self.bad += [i for i in waiting if i not in self.came]
        if not lost and not self.ok:
            return self._end("failed", at)
        self.redrives += 1
        if self.redrives > MOST_REDRIVES:
            self.redrives = MOST_REDRIVES
            return self._end("failed", at)
        if lost:
            self.last = at
            return self._row("redrive", at, lost)
        return self._end("published", at)

    def until(self, now: int) -> Iterator[tuple]:
        """The deadlines before ``now``."""
        while not self.ended and self.last and self.deadline() < now:
            yield self.stall()

    def take(self, kind: str, at: int, idx: int, expected: int) -> Iterator[tuple]:
        """One delivery."""
        if kind == "tick":
            return
        yield from self.until(at)
        if self.ended:
            yield self._row("ignored", at, [idx])
            return
        self.expected, self.last = max(self.expected, expected), max(self.last, at)
        if kind == "created":
            return
        if idx not in self.came:
            self.came.append(idx)
        if kind in ("extracted", "failed") and idx not in self.ok and idx not in self.bad:
            (self.ok if kind == "extracted" else self.bad).append(idx)
        if len(self.ok) + len(self.bad) >= self.expected:
            yield self._end("published" if self.ok else "failed", at)


def _in_order(rows: pd.DataFrame) -> Iterator[tuple[str, int, int, int]]:
    at = rows["event_time"].astype("datetime64[ms]").astype("int64")
    rows = rows.assign(at=at, step=rows["kind"].map(KINDS.index)).sort_values(["at", "step", "idx"])
    yield from zip(rows["kind"], rows["at"], rows["idx"].fillna(-1).astype(int), rows["expected"].fillna(0).astype(int), strict=True)


def _table(job_id: int, actions: list[tuple]) -> pd.DataFrame:
    names = ["action", "at", "n_ok", "n_failed", "redrives", "files"]
    out = pd.DataFrame(actions, columns=names)
    out.insert(0, "job_id", job_id)
    out["at"] = pd.to_datetime(out["at"], unit="ms")
    return out


def fold(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """All actions of one job from all its deliveries, with every deadline after the last."""
    job, actions = Job(), []
    for delivery in _in_order(rows):
        actions += job.take(*delivery)
    actions += job.until(1 << 62)
    return _table(int(key[0]), actions)


def _step(clock: str, keep: int):
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        job = Job(*map(lambda x: list(x) if isinstance(x, (list, tuple)) else x, state.get)) if state.exists else Job()
        live = clock == "processing"
        now = state.getCurrentProcessingTimeMs() if live else state.getCurrentWatermarkMs()
        actions: list[tuple] = []
        if not state.hasTimedOut:
            rows = pd.concat(list(batches), ignore_index=True)
            if live:
                rows["event_time"] = pd.to_datetime(now, unit="ms")
            for delivery in _in_order(rows):
                actions += job.take(*delivery)
        actions += job.until(now)
        if job.ended and job.last + keep < now or not job.last:
            state.remove()
        else:
            state.update(astuple(job))
            due = job.last + keep if job.ended else job.deadline()
            if live:
                state.setTimeoutDuration(max(1, due - now + 1))
            else:
                state.setTimeoutTimestamp(max(due, now) + 1)
        if actions:
            yield _table(int(key[0]), actions)

    return step


def actions(stream: DataFrame, clock: str = "event", keep: int = KEEP) -> DataFrame:
    """The actions of all jobs, as a stream (or, of a batch of deliveries, as a table)."""
    read = stream.where("coalesce(part, 0) = 0").select("job_id", "kind", "event_time", "idx", "expected")
    if not stream.isStreaming:
        return read.groupBy("job_id").applyInPandas(fold, ACTIONS)
    timeout = GroupStateTimeout.ProcessingTimeTimeout if clock == "processing" else GroupStateTimeout.EventTimeTimeout
    return read.groupBy("job_id").applyInPandasWithState(_step(clock, keep), ACTIONS, STATE, "append", timeout)


