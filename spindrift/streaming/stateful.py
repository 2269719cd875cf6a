"""Token buckets and circuit breakers over attempts with their own times: replayed as a batch, or kept up on a stream.

Both have one step function; a key's rows are taken in order of time and sequence. As no clock but the rows' own is read,
a replay gives the same rows as the stream that it replays."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


@dataclass(frozen=True)
class TokenBucket:
    """A sustained rate and a burst for each key. An idle key starts anew after idle_ttl seconds."""

    rate: float
    burst: float = 1.0
    idle_ttl: float = 15 * 60.0

    def __post_init__(self) -> None:
        if self.rate <= 0 or self.burst <= 0 or self.idle_ttl < 0:
            raise ValueError("rate and burst must be above 0, idle_ttl not below")

    columns = "wait double, tokens double"

    def start(self) -> dict[str, Any]:
        return {"tokens": self.burst, "at": None, "used": None}

    def step(self, s: dict[str, Any], ts: float, row: Any) -> tuple[float, float]:
        """(seconds that the attempt has to wait, tokens left). Attempts queue: the next starts where the last waited to."""
        if s["used"] is not None and self.idle_ttl and ts - s["used"] >= self.idle_ttl:
            s.update(self.start())
        at = ts if s["at"] is None else s["at"]
        now = max(ts, at)
        s["tokens"] = min(self.burst, s["tokens"] + (now - at) * self.rate)
        wait = now - ts
        if s["tokens"] < 1:
            more = (1 - s["tokens"]) / self.rate
            wait, now, s["tokens"] = wait + more, now + more, 1.0
        s["tokens"] -= 1
        s["at"], s["used"] = now, max(ts, now)
        return wait, s["tokens"]


@dataclass(frozen=True)
class CircuitBreaker:
    """Opens after so many failures in a row; after the cooldown lets one attempt probe, whose outcome closes or reopens.

    An attempt is admitted at its time and ends at once, or after its duration: until then a probe keeps others out, and
    an outcome from before the circuit opened doesn't touch it."""

    threshold: int = 3
    cooldown: float = 60.0

    def __post_init__(self) -> None:
        if self.threshold < 1 or self.cooldown < 0:
            raise ValueError("threshold must be at least 1, cooldown not below 0")

    columns = "admitted boolean, state string, failures int"

    def start(self) -> dict[str, Any]:
        return {"state": "closed", "failures": 0, "until": 0.0, "generation": 0, "pending": []}

    def _settle(self, s: dict[str, Any], ts: float) -> None:
        due = sorted(p for p in s["pending"] if p[0] <= ts)
        s["pending"] = [p for p in s["pending"] if p[0] > ts]
        for end, ok, generation in due:
            if generation != s["generation"]:
                continue
            if ok:
                s.update(state="closed", failures=0, until=0.0)
                continue
            s["failures"] += 1
            if s["state"] == "half_open" or s["failures"] >= self.threshold:
                s.update(state="open", until=end + self.cooldown, generation=s["generation"] + 1)

    def step(self, s: dict[str, Any], ts: float, row: Any) -> tuple[bool, str, int]:
        self._settle(s, ts)
        if s["state"] == "open" and ts >= s["until"]:
            s["state"] = "half_open"
        probing = s["state"] == "half_open" and any(p[2] == s["generation"] for p in s["pending"])
        admitted = s["state"] == "closed" or s["state"] == "half_open" and not probing
        if admitted:
            s["pending"].append([ts + float(row.duration), bool(row.ok), s["generation"]])
            self._settle(s, ts)
        return admitted, s["state"], s["failures"]


Machine = TokenBucket | CircuitBreaker


def _attempts(df: DataFrame, key: str, ts: str, seq: str, ok: str | None, duration: str | None):
    seconds = F.col(ts).cast("double") if dict(df.dtypes)[ts] in ("double", "bigint", "int", "float") else F.unix_micros(F.col(ts).cast("timestamp")) / 1e6
    return df.select(
        F.col(key).cast("string").alias("key"),
        F.col(seq).cast("long").alias("seq"),
        seconds.alias("at"),
        F.coalesce(F.col(ok), F.lit(False)).alias("ok") if ok else F.lit(True).alias("ok"),
        F.coalesce(F.col(duration).cast("double"), F.lit(0.0)).alias("duration") if duration else F.lit(0.0).alias("duration"),
    ).where("key is not null and at is not null")


def _run(machine: Machine, state: dict[str, Any], rows: pd.DataFrame) -> pd.DataFrame:
    names = [c.split()[0] for c in machine.columns.split(", ")]
    out = [machine.step(state, r.at_, r) for r in rows.rename(columns={"at": "at_"}).itertuples(index=False)]
    done = rows[["key", "seq"]].reset_index(drop=True)
    return pd.concat([done, pd.DataFrame(out, columns=names)], axis=1)


def replay(df: DataFrame, machine: Machine, key: str, ts: str, seq: str, ok: str | None = None, duration: str | None = None) -> DataFrame:
    """(key, seq, and what the machine says) of each attempt. One shuffle by key, sorted within; a key's rows pass in
    chunks, so that none has to fit in memory."""

    def run(pages: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: dict[str, dict] = {}
        for page in pages:
            for k, rows in page.groupby("key", sort=False):
                if k not in state:
                    state = {k: machine.start()}  # rows are sorted by key: those before are done
                yield _run(machine, state[k], rows)

    rows = _attempts(df, key, ts, seq, ok, duration).repartition("key").sortWithinPartitions("key", "at", "seq")
    return rows.mapInPandas(run, f"key string, seq long, {machine.columns}")


def keep_up(df: DataFrame, machine: Machine, key: str, ts: str, seq: str, ok: str | None = None, duration: str | None = None, timeout: str | None = None) -> DataFrame:
    """The same over a stream: state by key, carried from batch to batch by the checkpoint."""

    def run(k: tuple, pages: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now = json.loads(state.get[0]) if state.exists else machine.start()
        rows = pd.concat(list(pages)).sort_values(["at", "seq"], kind="stable")
        yield _run(machine, now, rows)
        state.update((json.dumps(now),))
        if timeout:
            state.setTimeoutDuration(int(pd.Timedelta(timeout).total_seconds() * 1000))

    limit = GroupStateTimeout.ProcessingTimeTimeout if timeout else GroupStateTimeout.NoTimeout
    return _attempts(df, key, ts, seq, ok, duration).groupBy("key").applyInPandasWithState(run, f"key string, seq long, {machine.columns}", "state string", "append", limit)


def micro_batches(df: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict[str, Any] | None = None):
    """Starts a query that gives each micro-batch to handle, once a batch number: a batch that is tried again after a failure
    has its number again, by which handle can tell."""
    return df.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def windowed_counts(events: DataFrame, ts: str = "ts", by: str = "event_type", window: str = "1 hour", late: str | None = None) -> DataFrame:
    """(start, by, n, total) by event-time windows; with late, rows later than that are dropped on a stream."""
    rows = events.withWatermark(ts, late) if late else events
    return rows.groupBy(F.window(ts, window).alias("w"), by).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.col("w.start").alias("start"), by, "n", "total")
