"""What changes over time: sessions, caches, rate limits, settling; over tables and over streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window


def seconds(column: str = "ts"):
    return F.unix_micros(F.col(column).cast("timestamp")) / 1e6


def sessions(events: DataFrame, key: str = "user_id", ts: str = "ts", ttl: float = 1800.0) -> DataFrame:
    """Runs of a key's events with less than ``ttl`` seconds between: gaps and islands. A later event finds the session expired."""
    w = Window.partitionBy(key).orderBy(ts, "event_id")
    df = events.withColumn("_gap", seconds(ts) - F.lag(seconds(ts)).over(w))
    df = df.withColumn("session", F.sum((F.coalesce("_gap", F.lit(ttl)) >= ttl).cast("int")).over(w))
    return df.groupBy(key, "session").agg(F.count(F.lit(1)).alias("events"), F.min(ts).alias("started"), F.max(ts).alias("ended"))


class Entry:
    """A cache's entry of one key; ``take`` labels a lookup at a time."""

    def __init__(self, ttl: float, stale: float):
        self.ttl, self.stale, self.stored = ttl, stale, None

    def take(self, now: pd.Timestamp, event: int) -> str:
        age = None if self.stored is None else (now - self.stored).total_seconds()
        label = "miss" if age is None or age >= self.stale else "hit" if age < self.ttl else "stale"
        if label != "hit":
            self.stored = now
        return label


def cache_labels(events: DataFrame, key: str = "user_id", ts: str = "ts", ttl: float = 60.0, stale: float = 600.0) -> DataFrame:
    """miss, hit or stale for each lookup of a key. What is not a hit dates the entry anew, so a chain of hits ages from the last that was none."""
    return _batches_by(events, key, lambda: Entry(ttl, stale), "label string", [ts, "event_id"], ts, "event_id").select("event_id", key, "label")


class Bucket:
    """A token bucket; ``take`` tells whether a request at a time may pass."""

    def __init__(self, rate: float, burst: float, tokens: float | None = None, at: float | None = None):
        self.rate, self.burst, self.tokens, self.at = rate, burst, burst if tokens is None else tokens, at

    def take(self, now: float) -> bool:
        if self.at is not None:
            self.tokens = min(self.burst, self.tokens + max(0.0, now - self.at) * self.rate)
        self.at = now
        passes = self.tokens >= 1 - 1e-9
        self.tokens -= passes
        return passes


class _Timed(Bucket):
    def take(self, now: pd.Timestamp, event: int) -> bool:
        return super().take(now.timestamp())


def rate_limited(events: DataFrame, key: str = "user_id", ts: str = "ts", rate: float = 1 / 3600, burst: float = 3) -> DataFrame:
    """Whether each event passes its key's token bucket. A task holds the bucket, not the key's history."""
    return _batches_by(events, key, lambda: _Timed(rate, burst), "label boolean", [ts, "event_id"], ts, "event_id").select("event_id", key, F.col("label").alias("passes"))


def rate_limited_stream(events: DataFrame, key: str = "user_id", ts: str = "ts", rate: float = 1 / 3600, burst: float = 3, idle_ms: int | None = 3_600_000) -> DataFrame:
    """The same over a stream: a bucket a key is the state; one that is idle for an hour is full again and goes (None: all stay)."""
    kind = events.schema[key].dataType.simpleString()

    def fold(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        bucket = Bucket(rate, burst, *(state.get if state.exists else ()))
        frame = pd.concat(list(frames)).sort_values([ts, "event_id"])
        passes = [bucket.take(t.timestamp()) for t in frame[ts]]
        state.update((bucket.tokens, bucket.at))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({"event_id": frame["event_id"], key: frame[key], "passes": passes})

    return events.select("event_id", key, ts).groupBy(key).applyInPandasWithState(fold, f"event_id long, `{key}` {kind}, passes boolean", "tokens double, at double", "append", GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


def windowed(events: DataFrame, ts: str = "ts", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by tumbling window and type; on a stream, rows later than ``late`` are left out."""
    dated = events.withColumn(ts, F.col(ts).cast("timestamp"))
    dated = dated.withWatermark(ts, late) if events.isStreaming else dated
    return dated.groupBy(F.window(ts, width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("started"), "event_type", "n", "total")


class Stack:
    """Visits of a session: a visit cuts what lay ahead, and the oldest beyond ``most`` goes."""

    def __init__(self, most: int):
        self.most, self.entries, self.at = most, [], -1

    def take(self, ts: pd.Timestamp, event: int, move: str) -> None:
        if move == "back":
            self.at = max(self.at - 1, 0) if self.entries else -1
        elif move == "forward":
            self.at = min(self.at + 1, len(self.entries) - 1)
        else:
            self.entries = [*self.entries[: self.at + 1], event][-self.most :]
            self.at = len(self.entries) - 1

    def result(self) -> tuple[int, int, int]:
        return len(self.entries), self.at, self.entries[self.at] if self.entries else -1


def history(events: DataFrame, key: str = "user_id", ts: str = "ts", most: int = 50) -> DataFrame:
    """Where each session stands after its visits, backs and forwards. Rows are sorted and stream through; a task holds one stack of at most ``most`` visits."""
    kind = events.schema[key].dataType.simpleString()
    rows = events.select(key, ts, "event_id", "move").repartition(key).sortWithinPartitions(key, ts, "event_id")

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unset = object()
        now, stack = unset, Stack(most)
        for frame in frames:
            done = []
            for row in frame.itertuples(index=False):
                own = None if pd.isna(row[0]) else row[0]
                if own != now:
                    done += [] if now is unset else [(now, *stack.result())]
                    now, stack = own, Stack(most)
                stack.take(*row[1:])
            yield pd.DataFrame(done, columns=[key, "entries", "place", "current"])
        if now is not unset:
            yield pd.DataFrame([(now, *stack.result())], columns=[key, "entries", "place", "current"])

    return rows.mapInPandas(each, f"`{key}` {kind}, entries int, place int, current long")


def settled_at(changes: DataFrame, group: list[str], ts: str = "ts", quiet_ms: int = 60, deadline_ms: int = 5000) -> DataFrame:
    """When each group comes to rest: ``quiet_ms`` after the first change that none follows within that time, at the latest ``deadline_ms`` after its start."""
    at = F.unix_millis(F.col(ts).cast("timestamp"))
    w = Window.partitionBy(*group).orderBy("_at")
    gaps = changes.select(*group, at.alias("_at")).withColumn("_next", F.lead("_at").over(w))
    rest = F.min(F.when(F.coalesce(F.col("_next") - F.col("_at") > quiet_ms, F.lit(True)), F.col("_at")))
    out = gaps.groupBy(*group).agg(F.min("_at").alias("_start"), rest.alias("_rest"), F.count(F.lit(1)).alias("changes"))
    settled = F.col("_rest") + quiet_ms - F.col("_start")
    return out.select(*group, "changes", F.least(settled, F.lit(deadline_ms).cast("long")).alias("settled_ms"), (settled > deadline_ms).alias("timed_out"))


def _batches_by(df: DataFrame, group: str, fold_type: Callable[[], object], schema: str, order: list[str], *inputs: str) -> DataFrame:
    """A fold over each group's rows in order. Rows are sorted, then stream through in Arrow batches; only the fold's own state is held, so a hot group costs no memory."""
    sorted_rows = df.select(group, *inputs).repartition(group).sortWithinPartitions(group, *order)

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unset = object()
        now, fold = unset, None
        for frame in frames:
            labels = []
            for row in frame.itertuples(index=False):
                own = None if pd.isna(row[0]) else row[0]
                if now is unset or own != now:
                    now, fold = own, fold_type()
                labels.append(fold.take(*row[1:]))
            yield frame.assign(label=labels)

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in (group, *inputs))
    return sorted_rows.mapInPandas(each, f"{kinds}, {schema}")


def throttled(events: DataFrame, group: str, ts: str = "ts", order: str = "event_id", every_ms: int = 500) -> DataFrame:
    """Which progress notes get through (label sent or held): none within ``every_ms`` of the last one that did."""

    class Throttle:
        last = None

        def take(self, at, _ident) -> str:
            if self.last is not None and (at - self.last).total_seconds() * 1000 < every_ms:
                return "held"
            self.last = at
            return "sent"

    return _batches_by(events, group, Throttle, "label string", [ts, order], ts, order)


class Store:
    """Entries with a time to live and a capacity; the oldest goes first. What was evicted leaves a tombstone for a while, what was closed does not."""

    def __init__(self, most: int = 256, ttl: float = 1800.0, remembered: float = 86_400.0, most_tombstones: int = 4096):
        self.most, self.ttl, self.remembered, self.most_tombstones = most, ttl, remembered, most_tombstones
        self.at: dict = {}  # in order of last use
        self.gone: dict = {}  # in order of eviction: (time, reason)

    def _bury(self, key, now: float, reason: str) -> None:
        self.at.pop(key)
        self.gone.pop(key, None)
        self.gone[key] = (now, reason)
        while len(self.gone) > self.most_tombstones:
            self.gone.pop(next(iter(self.gone)))

    def take(self, now: float, key, close: bool = False) -> str:
        """created, used, closed, absent, expired (idle) or expired (capacity)."""
        while self.at and now - next(iter(self.at.values())) >= self.ttl:
            self._bury(next(iter(self.at)), now, "idle")
        if key in self.at:
            self.at.pop(key)
            if not close:
                self.at[key] = now
            return "closed" if close else "used"
        if close:
            return "absent"
        if key in self.gone:
            when, reason = self.gone[key]
            if now - when < self.remembered:
                return f"expired ({reason})"
            self.gone.pop(key)
        while len(self.at) >= self.most:
            self._bury(next(iter(self.at)), now, "capacity")
        self.at[key] = now
        return "created"


def session_labels(events: DataFrame, owner: str, key: str, ts: str = "ts", order: str = "event_id", close: str | None = None, most: int = 256, ttl: float = 1800.0) -> DataFrame:
    """What becomes of each use of a session, by owner of the store: see ``Store.take``. Holds ``most`` entries and the tombstones, however many rows an owner has."""

    class Sessions(Store):
        def __init__(self):
            super().__init__(most, ttl)

        def take(self, at, _ident, name, *closing) -> str:
            return super().take(at.timestamp(), name, bool(closing and closing[0]))

    return _batches_by(events, owner, Sessions, "label string", [ts, order], ts, order, key, *([close] if close else []))


def site_cache_labels(lookups: DataFrame, owner: str, key: str, found: str, ts: str = "ts", order: str = "event_id", most: int = 128, ttl: float = 600.0) -> DataFrame:
    """miss, hit or negative hit (absence is kept as well) for each lookup; ``found`` is what a fetch would bring. An entry ages from its fetch; the oldest fetch goes first."""

    class Cache:
        def __init__(self):
            self.held: dict = {}

        def take(self, at, _ident, name, there) -> str:
            now = at.timestamp()
            if name in self.held and now - self.held[name][0] < ttl:
                return "hit" if self.held[name][1] else "negative hit"
            self.held.pop(name, None)
            while len(self.held) >= most:
                self.held.pop(next(iter(self.held)))
            self.held[name] = (now, bool(there))
            return "miss"

    return _batches_by(lookups, owner, Cache, "label string", [ts, order], ts, order, key, found)
