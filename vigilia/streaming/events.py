"""The time-bucketed operators over streams: hour slots, days, bursts and gap sessions, runs of categories, repeated events, flows and their actors, with watermarks.

A batch of a finished day and a stream of it agree once the watermark has
passed. Scoring joins tables of the baseline, which stand still, in
`foreachBatch`.
"""

from __future__ import annotations

import json
import pickle
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from vigilia.functions import fixed
from vigilia.sources.logs import EVENT


def read_event_stream(spark: SparkSession, path: str, schema: str = EVENT, files_per_trigger: int = 100) -> DataFrame:
    """JSON lines of events as files arrive under a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("recursiveFileLookup", True).json(path)


def slot_counts(events: DataFrame, unit: str = "1 hour", late: str = "1 hour", by: str = "actor") -> DataFrame:
    """(by, slot_start, n) per hour or day; events later than the watermark are dropped."""
    rows = events.withWatermark("event_time", late).groupBy(F.window("event_time", unit), by).agg(F.count("*").alias("n"))
    return rows.select(by, F.col("window.start").alias("slot_start"), "n")


def gap_sessions(events: DataFrame, gap_minutes: int = fixed.GAP_MINUTES, late: str = "1 hour", by: str = "identity_id") -> DataFrame:
    """(by, session_start, session_end, num_events and counts per sensitive category) of sessions that the watermark has closed.

    A window closes `gap_minutes` after its last event; one microsecond is
    added, as a session goes on over a gap of exactly that length.
    """
    window = F.session_window("event_time", f"{gap_minutes * 60} seconds 1 microsecond")
    count = lambda c: F.count_if(F.col("action_category") == c)
    rows = events.withWatermark("event_time", late).groupBy(window.alias("w"), by).agg(
        F.min("event_time").alias("session_start"), F.max("event_time").alias("session_end"), F.count("*").alias("num_events"),
        *(count(c).alias(f"num_{n}_actions") for n, c, _ in fixed.SENSITIVE_WEIGHTS), count("DataAccess").alias("num_data_access_actions"),
    )
    return rows.drop("w")


def first_events(events: DataFrame, late: str = "1 hour", key: str = "event_uid") -> DataFrame:
    """The events without those whose key came before within the watermark; state is kept that long and no longer."""
    return events.withWatermark("event_time", late).dropDuplicatesWithinWatermark([key])


def flows_with_actor(flows: DataFrame, sightings: DataFrame, back: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Flows (src_ip, event_time, event_uid) with the last actor that sightings (ip, actor, event_time, event_uid) saw at their address up to `back` before, null if none did.

    A join of two streams over a bounded span of time, then the latest sighting
    of each flow; both states end with the watermark. Of sightings at one time
    the one of the greatest uid counts.
    """
    left = flows.select("src_ip", "event_time", "event_uid").withWatermark("event_time", late)
    right = sightings.select(F.col("ip").alias("_ip"), "actor", F.col("event_time").alias("_seen"), F.col("event_uid").alias("_uid")).withWatermark("_seen", late)
    near = (F.col("src_ip") == F.col("_ip")) & (F.col("_seen") <= F.col("event_time")) & (F.col("_seen") >= F.col("event_time") - F.expr(f"INTERVAL {back}"))
    return left.join(right, near, "left_outer").groupBy("event_time", "event_uid", "src_ip").agg(F.max_by("actor", F.struct("_seen", "_uid")).alias("actor"))


#: One closed session of `session_runs`; `runs` is a JSON object of counts per run of two and three categories.
RUNS = "identity_id string, session_start timestamp, session_end timestamp, num_events long, max_events_in_5min long, runs string"


class _OpenSession:
    """What an identity's open session needs to go on: no more events than lie in the window of a burst."""

    def __init__(self, start: int):
        self.start = self.last = start
        self.events = self.burst = 0
        self.near: list[int] = []
        self.tail: list[str] = []
        self.runs: Counter = Counter()

    def add(self, t: int, category: str, window: int) -> None:
        self.last, self.events = t, self.events + 1
        self.near = [u for u in self.near if u >= t - window] + [t]
        self.burst = max(self.burst, len(self.near))
        self.tail = [*self.tail[-2:], category]
        for n in range(2, len(self.tail) + 1):
            self.runs[" -> ".join(self.tail[-n:])] += 1


def session_runs(events: DataFrame, gap_minutes: int = fixed.GAP_MINUTES, late: str = "1 hour", burst_seconds: int = fixed.BURST_SECONDS) -> DataFrame:
    """Closed sessions with their greatest burst and their runs of categories, from (identity_id, event_time, event_uid, action_category).

    State of its own per identity: events wait until the watermark has passed
    them, so they are taken in the order of (time, uid) in which a batch takes
    them; a timer closes a session once the watermark lies beyond its gap.
    Events later than the watermark are dropped.
    """
    gap, window = gap_minutes * 60_000_000, burst_seconds * 1_000_000

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, session, passed = pickle.loads(state.get[0]) if state.exists else ([], None, -1)
        for frame in frames:
            waiting += [x for x in zip(frame["t"].tolist(), frame["event_uid"].tolist(), frame["action_category"].tolist()) if x[0] > passed]
        mark, closed = state.getCurrentWatermarkMs() * 1000, []

        def close() -> None:
            closed.append((key[0], pd.Timestamp(session.start, unit="us"), pd.Timestamp(session.last, unit="us"), session.events, session.burst, json.dumps(dict(sorted(session.runs.items())))))

        waiting.sort()
        ready = [x for x in waiting if x[0] <= mark]
        for t, _, category in ready:
            if session is not None and t - session.last > gap:
                close()
                session = None
            if session is None:
                session = _OpenSession(t)
            session.add(t, category, window)
        waiting, passed = waiting[len(ready) :], max(mark, passed)
        if session is not None and mark > session.last + gap:
            close()
            session = None
        if session is None and not waiting:
            state.remove()
        else:
            state.update((pickle.dumps((waiting, session, passed)),))
            due = min(([waiting[0][0]] if waiting else []) + ([session.last + gap] if session is not None else []))
            state.setTimeoutTimestamp(max(due // 1000, state.getCurrentWatermarkMs()) + 1)
        if closed:
            yield pd.DataFrame(closed, columns=[c.split(" ")[0] for c in RUNS.split(", ")])

    rows = events.withWatermark("event_time", late).select("identity_id", "event_time", F.unix_micros(F.col("event_time")).alias("t"), "event_uid", F.coalesce("action_category", F.lit("Other")).alias("action_category"))
    return rows.groupBy("identity_id").applyInPandasWithState(step, RUNS, "state binary", "append", GroupStateTimeout.EventTimeTimeout)


def unusual_slots(slots: DataFrame, baseline: DataFrame, least_z: float = 3.0) -> DataFrame:
    """Slots that lie `least_z` deviations over their actor's baseline (actor, mean, std): a join of a stream with a table."""
    z = (F.col("n") - F.col("mean")) / F.greatest("std", F.lit(1e-6))
    return slots.join(baseline, "actor").withColumn("z", z).where(F.col("z") >= least_z)


def write_scored(stream: DataFrame, score: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, once: bool = False) -> DataStreamWriter:
    """Score every micro-batch with a batch operator and write it to a folder of its own, so that a repeated batch replaces itself."""

    def each(batch: DataFrame, number: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    out = stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(each)
    return out.trigger(availableNow=True) if once else out
