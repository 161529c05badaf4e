"""Daily partials, canonical JSON and stored layouts."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from vigilia.operators import baseline as B
from vigilia.operators import incremental as I
from vigilia.sources import logs, tables

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def events(spark):
    r = random.Random(2)
    rows = [(r.choice(["a", "b", None, ""]), T0 + dt.timedelta(seconds=r.randint(0, 6 * 86400)), i, r.choice(["Get", "Put", None]), r.choice(["x", None, ""]), r.choice(["1", "2"]), r.choice([[], ["q"], ["q", "w"], None]), r.random() < 0.5) for i in range(300)]
    return spark.createDataFrame(rows, "actor string, event_time timestamp, event_uid long, operation string, region string, ip string, resources array<string>, is_system boolean")


def same(a, b):
    return sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect()))


def test_merged_equals_recomputed_and_a_new_day_costs_a_day(spark, events, tmp_path):
    path = str(tmp_path / "partials")
    day = F.to_date("event_time")
    first = events.where(day < "2024-01-05")
    tables.write_days(I.api_partials(first), path)
    tables.write_days(I.api_partials(events.where(day >= "2024-01-05")), path)  # more days, each computed alone
    stored = tables.read_days(spark, path, schema=I.PARTIAL)
    whole, want = I.api_baseline_of(stored), B.api_baseline(events)
    for column in ("event_count", "is_system", "known_ips", "known_regions", "known_resources", "known_operations", "volume_stats.mean", "volume_stats.std", "volume_stats.slots", "daily_events.mean", "daily_events.std"):
        assert same(want.select("actor", F.col(column).alias("x")), whole.select("actor", F.col(column).alias("x"))), column
    part = I.api_baseline_of(tables.read_days(spark, path, last="2024-01-04", schema=I.PARTIAL))
    assert same(B.api_baseline(first).select("actor", "event_count"), part)
    assert same(B.slot_stats(B.with_actor(events), "hour"), I.merged_stats(I.merged(stored), "hour_slots"))


def test_one_day_rewritten_leaves_the_others(spark, events, tmp_path):
    path = tmp_path / "partials"
    tables.write_days(I.api_partials(events), str(path))
    before = {str(p): p.stat().st_mtime_ns for p in path.rglob("*.parquet")}
    tables.write_days(I.api_partials(events.where("to_date(event_time) = '2024-01-03'").limit(5)), str(path))
    after = {str(p): p.stat().st_mtime_ns for p in path.rglob("*.parquet")}
    gone = {n for n in before if n not in after}
    assert len(gone) == 1 and all(after[n] == before[n] for n in before if n in after)
    assert tables.read_days(spark, str(path), "2024-01-03", "2024-01-03", schema=I.PARTIAL).where("kind = 'events'").agg(F.sum("n")).first()[0] <= 5


def test_no_events_no_partials(spark, events):
    none = I.api_partials(events.limit(0))
    assert none.count() == 0 and I.api_baseline_of(none).count() == 0
    assert [f"{n} {t}".replace("bigint", "long") for n, t in none.dtypes] == I.PARTIAL.split(", ")


def test_sums_of_bytes_are_exact(spark):
    rows = [("e", T0 + dt.timedelta(days=i), i, "d", 1, 6, b, "ACCEPT") for i, b in enumerate([10**15, 10**15 + 1, 10**15 + 2])]
    flows = spark.createDataFrame(rows, "eni string, event_time timestamp, event_uid long, dst_ip string, dst_port int, protocol int, bytes long, action string")
    got = I.flow_baseline_of(I.flow_partials(flows, "eni")).first()
    assert got.daily_bytes.std == 1.0 and got.known_dst_conns == ["d:1"] and got.event_count == 3


def test_buckets_join_without_an_exchange(spark, events, tmp_path):
    spark.sql("DROP TABLE IF EXISTS bucketed_a")
    spark.sql("DROP TABLE IF EXISTS bucketed_b")
    counts = B.with_actor(events).groupBy("actor", "ip").agg(F.count("*").alias("n"))
    a, b = tables.save_bucketed(counts, "bucketed_a", ["actor", "ip"], 4, str(tmp_path / "a")), tables.save_bucketed(counts.withColumnRenamed("n", "m"), "bucketed_b", ["actor", "ip"], 4, str(tmp_path / "b"))
    joined = a.hint("merge").join(b.hint("merge"), ["actor", "ip"])
    assert joined.where("n = m").count() == counts.count()
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    assert "Exchange" not in a.groupBy("actor", "ip").agg(F.sum("n"))._jdf.queryExecution().executedPlan().toString()


def test_raw_records_are_told_apart_by_all_their_fields(spark):
    lines = ['{"a": 1, "b": {"c": [1, 2], "d": null}}', '{ "b":{"d":null,"c":[1,2]},"a":1 }', '{"a": 1, "b": {"c": [2, 1], "d": null}}', '{"a": 1, "b": {"c": [1, 2], "d": null}, "unknown": 0}', "no json", " no json ", None, None, '{"a": "1"}', '{"a": 1}']
    rows = spark.createDataFrame([(x, i) for i, x in enumerate(lines)], "value string, place int")
    got = {r.value: r.copies for r in logs.deduplicate_raw(rows).collect()}
    assert sorted(got.values()) == [1, 1, 1, 1, 2, 2, 2] and got[None] == 2 and len(got) == 7
    assert logs.deduplicate_raw(rows.limit(0)).count() == 0
