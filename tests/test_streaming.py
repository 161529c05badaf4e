"""Streams agree with batches of the same events."""

import datetime as dt
import json
import random

from pyspark.sql import functions as F

from vigilia.functions import exprs as X
from vigilia.operators import baseline as B
from vigilia.operators import sessions as S
from vigilia.streaming import events as V

SCHEMA = "identity_id string, actor string, event_time timestamp, event_uid long, event_name string"


def files(spark, path):
    t0 = dt.datetime(2024, 1, 1)
    minutes = [("a", m) for m in (0, 10, 40, 71, 300)] + [("b", m) for m in (5, 36, 65)] + [("z", 60 * 24 * 3)]
    rows = spark.createDataFrame([(w, w, t0 + dt.timedelta(minutes=m), i, "CreateUser" if i % 2 else "GetObject") for i, (w, m) in enumerate(minutes)], SCHEMA)
    rows.coalesce(1).write.parquet(path)
    return rows.withColumn("action_category", X.action_category("event_name"))


def run(frame, tmp_path, name):
    out = V.write_scored(frame, lambda d: d, str(tmp_path / f"{name}_out"), str(tmp_path / f"{name}_check"), once=True).start()
    out.awaitTermination(120)
    return out


def test_sessions_and_slots(spark, tmp_path):
    rows = files(spark, str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")).withColumn("action_category", X.action_category("event_name"))
    run(V.gap_sessions(stream), tmp_path, "sessions")
    got = {(r.identity_id, r.session_start, r.num_events) for r in spark.read.parquet(str(tmp_path / "sessions_out")).collect()}
    batch = rows.withColumns({"event_source": F.lit("s"), "aws_region": F.lit("r"), "source_ip": F.lit("i"), "is_failed": F.lit(False), "is_sensitive": F.lit(False)})
    want = {(r.identity_id, r.session_start, r.num_events) for r in S.session_features(S.sessionize(batch)).where("identity_id <> 'z'").collect()}
    assert got == want
    run(V.slot_counts(stream), tmp_path, "slots")
    slots = spark.read.parquet(str(tmp_path / "slots_out"))
    assert slots.where("actor = 'a'").agg(F.sum("n")).first()[0] == 5
    base = B.slot_stats(rows.where("actor = 'b'"), "hour")
    assert V.unusual_slots(slots, base, -10).count() == 2


def test_runs_and_bursts_of_closed_sessions(spark, tmp_path):
    """Events out of order over several files: the stream's sessions, bursts and runs are those of the batch."""
    r = random.Random(5)
    t0, raw, m = dt.datetime(2024, 1, 1), [], 0
    for i in range(120):
        m += r.choice([0, 1, 1, 2, 29, 30, 31, 45])
        raw.append((r.choice("ab"), m * 60 + r.randint(0, 30), i, r.choice(["ListBuckets", "GetObject", "CreateUser", "PutBucketPolicy"])))
    raw.append(("z", (m + 10**5) * 60, 999, "GetObject"))
    for k in range(0, len(raw), 30):
        part = sorted(raw[k : k + 30], key=lambda _: r.random())
        rows = [(w, w, t0 + dt.timedelta(seconds=s), i, n) for w, s, i, n in part]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withColumn("action_category", X.action_category("event_name"))
    run(V.session_runs(stream, 30, "40 days"), tmp_path, "runs")
    got = {(r.identity_id, r.session_start, r.session_end, r.num_events, r.max_events_in_5min, r.runs) for r in spark.read.parquet(str(tmp_path / "runs_out")).collect()}
    batch = spark.read.parquet(str(tmp_path / "in")).where("identity_id <> 'z'").withColumns({
        "action_category": X.action_category("event_name"), "event_source": F.lit("s"), "aws_region": F.lit("r"), "source_ip": F.lit("i"), "is_failed": F.lit(False), "is_sensitive": F.lit(False),
    })
    want = set()
    for f in S.session_features(S.sessionize(batch, 30)).collect():
        runs = {g.gram: g.n for g in f.grams if g.kind in ("category2", "category3")}
        want.add((f.identity_id, f.session_start, f.session_end, f.num_events, f.max_events_in_5min, json.dumps(dict(sorted(runs.items())))))
    assert got == want and len(want) > 5


def test_repeated_and_late_events(spark, tmp_path):
    """A repeat within the watermark goes, also in a later file; the first copy stays."""
    t0 = dt.datetime(2024, 1, 1)
    for part in ([("a", 0, 1), ("a", 1, 2), ("a", 0, 1)], [("b", 2, 2), ("b", 3, 3)], [("c", 600, 4), ("c", 600, 4)]):
        spark.createDataFrame([(w, w, t0 + dt.timedelta(minutes=m), i, "X") for w, m, i in part], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run(V.first_events(stream, "1 hour"), tmp_path, "first")
    assert sorted(r.event_uid for r in spark.read.parquet(str(tmp_path / "first_out")).collect()) == [1, 2, 3, 4]


def test_flows_meet_the_last_actor_of_their_address(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    at = lambda m: t0 + dt.timedelta(minutes=m)
    seen = spark.createDataFrame([("i", "old", at(0), 1), ("i", "new", at(20), 2), ("i", "later", at(45), 3), ("j", "far", at(0), 4), ("k", "end", at(3000), 5)], "ip string, actor string, event_time timestamp, event_uid long")
    flows = spark.createDataFrame([("i", at(10), 10), ("i", at(30), 11), ("j", at(100), 12), ("x", at(5), 13), ("k", at(3000), 14)], "src_ip string, event_time timestamp, event_uid long")
    for rows, name in ((seen, "seen"), (flows, "flows")):
        rows.coalesce(1).write.parquet(str(tmp_path / name))
    read = lambda rows, name: spark.readStream.schema(rows.schema).parquet(str(tmp_path / name))
    run(V.flows_with_actor(read(flows, "flows"), read(seen, "seen")), tmp_path, "joined")
    got = {r.event_uid: r.actor for r in spark.read.parquet(str(tmp_path / "joined_out")).collect()}
    assert {k: got[k] for k in (10, 11, 12, 13)} == {10: "old", 11: "new", 12: None, 13: None}
