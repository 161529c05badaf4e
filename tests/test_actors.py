"""Baselines, profiles, scores of actors and findings on rows computed by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from vigilia.functions import exprs as X
from vigilia.operators import baseline as B
from vigilia.operators import findings as R
from vigilia.operators import ueba as U

D0 = dt.datetime(2024, 1, 1)
API = "actor string, event_time timestamp, event_uid long, operation string, region string, ip string, resources array<string>, is_system boolean"


def api(spark, rows):
    """rows: (actor, hours after D0, operation, region, ip, resources)."""
    return spark.createDataFrame([(a, None if h is None else D0 + dt.timedelta(hours=h), i, o, g, p, r, False) for i, (a, h, o, g, p, r) in enumerate(rows)], API)


@pytest.mark.parametrize("x, mean, std, want", [(16.0, 10.0, 2.0, 1.0), (13.0, 10.0, 2.0, 0.5), (7.0, 10.0, 2.0, 0.5), (15.0, 10.0, 0.0, 0.5), (5.0, 10.0, 0.0, 0.0), (0.5, 0.0, 0.0, 0.5), (9.0, 0.0, 0.0, 1.0)])
def test_deviation(spark, x, mean, std, want):
    assert spark.range(1).select(X.deviation(F.lit(x), F.lit(mean), F.lit(std)).alias("d")).first().d == pytest.approx(want)


def test_baseline(spark):
    rows = api(spark, [("a", 0, "Get", "r1", "i1", ["x", "y"]), ("a", 0.5, "Get", "r1", "i2", ["x"]), ("a", 30, "Put", "r2", "i1", []), ("", 1, "Get", "r", "i", []), (None, 1, "Get", "r", "i", []), ("b", 5, None, None, None, None)])
    got = {r.actor: r for r in B.api_baseline(rows).collect()}
    assert set(got) == {"a", "b"}
    a = got["a"]
    assert a.known_ips == ["i1", "i2"] and a.known_resources == ["x", "y"] and a.known_operations == {"Get": 2, "Put": 1} and a.known_hours == {0: 2, 6: 1} and a.event_count == 3
    assert a.volume_stats.asDict() == {"mean": 1.5, "std": 0.7071, "slots": 2} and a.daily_events.mean == 1.5 and got["b"].volume_stats.std == 0 and got["b"].known_operations == {"": 1}


def test_event_dimensions(spark):
    base = api(spark, [("a", h, "Get", "r1", "i1", ["x"]) for h in (0, 0.1, 24, 24.1, 49)])
    now = api(spark, [
        ("a", 100 * 24, "Get", "r1", "i1", ["x"]), ("a", 101 * 24 + 3, None, "r2", "i9", ["x", "z"]), ("a", 102 * 24 + 1, "Get", "r1", "i9", None), ("a", None, "Get", None, "i9", []), ("new", 1, "Get", "r1", "i1", ["x"]),
    ])
    got = {r.event_uid: r for r in U.api_event_dimensions(now, base).collect()}
    assert set(got) == {0, 1, 2, 3}
    dims = lambda k: tuple(round(got[k][d], 4) for d in ("d_op", "d_resource", "d_region", "d_ip", "d_hour"))
    assert dims(0) == (0, 0, 0, 0, 0) and dims(1) == (1, 1, 1, 0, 1) and dims(2) == (0, 0, 0, 1, 0.75) and dims(3) == (0, 0, 0, 0, 0)
    assert got[3].d_volume == 0 and got[0].d_volume == pytest.approx(abs(1 - 1.6667) / 0.5774 / 3, abs=1e-3)
    scores = U.api_scores(U.api_event_dimensions(now, base)).first()
    assert scores.event_count == 4 and scores.score_max == pytest.approx(round(got[1].composite, 4))


def test_access_and_flow_scores(spark):
    schema = "actor string, event_time timestamp, operation string, bucket string, ip string, bytes long, code int"
    base = spark.createDataFrame([("a", D0 + dt.timedelta(days=d), "Get", "b1", "i1", 100, 200) for d in range(3)], schema)
    day = spark.createDataFrame([("a", D0, "Get", "b2", "i1", 150, 200), ("a", D0, "Get", "b1", "i1", 0, 404), ("n", D0, "Get", "b", "i", None, None)], schema)
    got = {r.actor: r for r in U.access_scores(day, base).collect()}
    assert got["a"].has_baseline and (got["a"].new_operation, got["a"].new_bucket, got["a"].new_src_ip, got["a"].error_rate, got["a"].bytes_zscore, got["a"].event_zscore) == (0, 1, 0, 0.5, 0.5, 1)
    assert not got["n"].has_baseline and got["n"].bytes_zscore == 0 and got["n"].score == pytest.approx(round(4 / 6, 4))
    profile = {r.actor: r for r in B.access_profile(day).collect()}
    assert profile["a"].bytes_max_time == D0 and profile["n"].bytes_max_time is None and [tuple(x) for x in profile["a"].response_codes] == [(200, 1), (404, 1)]


def test_flow_resolution_and_ports(spark):
    schema = "eni string, src_ip string, dst_ip string, dst_port int, protocol int, bytes long, action string, event_time timestamp"
    flow = spark.createDataFrame([("e1", "i2", "d", 443, 6, 5, "ACCEPT", D0), ("e1", "i1", "d", 443, 6, 5, "REJECT", D0), ("e1", "zz", "d", 80, 6, 0, "ACCEPT", D0), ("e2", "zz", "d", 80, 6, 0, "ACCEPT", D0)], schema)
    actors = B.last_actor_by_ip(api(spark, [("a", 0, "G", "r", "i1", []), ("b", 1, "G", "r", "i1", []), ("c", 0, "G", "r", "i2", [])]))
    assert {r.src_ip: r.actor for r in actors.collect()} == {"i1": "b", "i2": "c"}
    assert {r.eni: (r.actor, r.resolved_ip) for r in B.resolve_interfaces(flow, actors).collect()} == {"e1": ("b", "i1"), "e2": (None, None)}
    assert sorted((r.eni, r.src_ip, r.actor) for r in B.resolve_flows(flow, actors).collect()) == [("e1", "i1", "b"), ("e1", "i2", "c"), ("e1", "zz", "c"), ("e2", "zz", "e2")]
    profile = {r.eni: r for r in B.flow_profile(flow, ["eni"]).collect()}
    assert profile["e1"].dst_ports == [443] and [tuple(x) for x in profile["e1"].port_counts] == [(443, 2), (80, 1)] and profile["e1"].reject_count == 1 and profile["e2"].bytes_max_time is None


def test_combination_and_findings(spark):
    one = lambda rows: spark.createDataFrame(rows, "actor string, score double, has_baseline boolean")
    got = {r.actor: r for r in U.combine_scores(one([("a", 0.2, True)]), one([("a", 0.6, False), ("b", 0.1, False)]), one([("e", 0.3, True)])).collect()}
    assert got["a"].final_score == 0.6 and got["a"].sources_used == ["cloudtrail", "s3"] and not got["b"].has_any_baseline and got["e"].has_any_baseline
    scores = spark.createDataFrame([("2024-01-01", "a", 0.5), ("2024-01-02", "a", 0.5), ("2024-01-01", "z", 0.0)], "day string, actor string, final_score double")
    alerts = spark.createDataFrame([("e", 50.0, 0.0), ("a", 0.0, 39.9)], "actor string, network_risk_score double, time_based_risk_score double")
    sessions = spark.createDataFrame([("a", "s1", 80.0), ("c", "s2", 10.0)], "identity_id string, session_id string, session_risk_score double")
    rows = {r.actor: r for r in R.findings_matrix(scores, alerts, sessions).collect()}
    assert set(rows) == {"a", "e", "c"} and rows["a"].signals == 2 and rows["a"].peak_day == "2024-01-01" and rows["e"].signals == 1 and rows["a"].signals_of == 4
    assert [r.actor for r in R.findings_matrix(scores, alerts, None).collect()] == ["a", "e"]
    assert set(r.actor for r in R.findings_matrix(scores, alerts, sessions, 1).collect()) == {"a", "e"}


def test_period_tables(spark):
    items = spark.createDataFrame([("a", "op", "x", "d2"), ("a", "op", "x", "d1"), ("a", "op", "k", "d1"), ("n", "op", "x", "d1")], "actor string, kind string, item string, day string")
    known = spark.createDataFrame([("a", "op", "k")], "actor string, kind string, item string")
    assert [tuple(r) for r in R.period_anomalies(items, known).collect()] == [("a", "op", "x", "d1")]
    hours = lambda h: spark.createDataFrame([("a", x) for x in h], "actor string, hour int")
    grid = {r.hour: r.state for r in R.hour_grid(hours([1, 2]), hours([2, 3])).collect()}
    assert len(grid) == 24 and [grid[h] for h in range(4)] == ["inactive", "baseline", "both", "incident"]
    level = lambda v, m, s: spark.range(1).select(R.volume_comparison(F.lit(v), F.lit(m), F.lit(s))["level"].alias("l")).first().l
    assert [level(30.0, 10.0, 0.0), level(14.0, 10.0, 2.0), level(15.0, 10.0, 0.0), level(11.0, 10.0, 5.0), level(5.0, 0.0, 1.0)] == ["red", "red", "amber", "green", None]


def test_resources_sharing_a_uid_space(spark):
    base = api(spark, [("a", 0, "Get", "r", "i", ["x"])])
    assert U.api_event_dimensions(api(spark, []), base).count() == 0


def test_half_of_all_events_on_one_actor_are_dealt_over_tasks(spark):
    """One service account with one region and one hour: its events reach the join in copies' shares, and the result is that of one task."""
    rows = [("svc" if i % 2 else f"u{i % 7}", D0 if i % 2 else D0 + dt.timedelta(hours=i % 5), f"Op{i % 3}" if i % 4 == 0 else "Op", "r", "ip", [], False) for i in range(4000)]
    schema = "actor string, event_time timestamp, operation string, region string, ip string, resources array<string>, is_system boolean"
    events = spark.createDataFrame(rows, schema).withColumn("event_uid", F.monotonically_increasing_id())
    base = events.where("event_uid % 3 = 0")
    spread, single = U.api_event_dimensions(events, base, 256), U.api_event_dimensions(events, base, 1)
    assert sorted(map(str, spread.collect())) == sorted(map(str, single.collect())) and spread.count() == 4000
    found = U.api_combinations(events, base)
    hot = found.where("actor = 'svc'").agg(F.max("_events")).first()[0]
    keys = spread._jdf.queryExecution().optimizedPlan().toString()
    assert hot >= 1000 and "_copy" in keys  # its largest combination alone would be a quarter of all rows in one task
    largest = hot / -(-hot * 256 // 4000)
    assert largest <= 4000 / 256


@pytest.mark.parametrize("rows", [
    [(0.9, True), (0.8, False), (0.8, True), (0.3, False), (None, True)], [(0.5, True)] * 3 + [(0.5, False)] * 2, [(1.0, False)], [], [(i % 37 / 7, i % 3 == 0) for i in range(500)], [(0.1, None), (0.2, True)],
])
def test_curves_equal_brute_force(spark, rows):
    from vigilia.operators import curves as C

    points = C.curve(spark.createDataFrame(rows, "score double, hit boolean"), "score", "hit")
    value = [(float("-inf") if s is None else s, bool(h)) for s, h in rows]
    p, n = sum(h for _, h in value), sum(not h for _, h in value)
    got = sorted(tuple(r) for r in points.select("threshold", "tp", "fp", "recall", "fall_out", "precision").collect())
    want = []
    for t in sorted({s for s, _ in value}):
        tp, fp = sum(s >= t and h for s, h in value), sum(s >= t and not h for s, h in value)
        want.append((t, tp, fp, tp / p if p else None, fp / n if n else None, tp / (tp + fp)))
    assert got == want
    area = C.areas(points).first()
    pairs = [(a > b) + (a == b) / 2 for a, h in value if h for b, g in value if not g]
    assert area.roc_auc == (pytest.approx(sum(pairs) / len(pairs)) if pairs else None)


def test_daily_scores_come_from_combinations_and_scoring_merges_nothing(spark):
    from vigilia.operators import incremental as I

    events = api(spark, [("a", i * 1800, op, ip, reg, [r]) for i, (op, ip, reg, r) in enumerate([("GetObject", "1", "r", "x"), ("GetObject", "1", "r", "y"), ("PutObject", "2", "r", "x"), ("", "1", "s", "z")] * 30)])
    base, now = events.where("event_uid < 60"), events.where("event_uid >= 40")
    day = U.api_event_dimensions(now, base).withColumn("day", F.to_date("event_time"))
    told = lambda f: sorted(tuple(sorted(r.asDict().items())) for r in f.collect())
    assert told(U.api_daily_scores(now, base)) == told(U.api_scores(day, ["actor", "day"]))
    columns = ["actor", "kind", "value", "n", "total", "squares"]
    whole = I.merged(I.api_partials(base, daily=False)).where("kind <> 'day_slots'").select(columns)
    assert told(I.api_period(base).select(columns)) == told(whole)
    plan = I.api_period(base)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "transform(" not in plan


def test_curves_of_counted_rows_equal_those_of_single_ones(spark):
    from vigilia.operators import curves as C

    rows = spark.createDataFrame([(s, h) for s, p, n in ((0.9, 3, 1), (0.5, 2, 2), (0.1, 0, 4)) for h in [True] * p + [False] * n], "score double, hit boolean")
    counted = spark.createDataFrame([(0.9, 1, 2), (0.9, 2, 2), (0.5, 2, 4), (0.1, 0, 4)], "score double, hit long, events long")
    told = lambda f: sorted(map(tuple, f.collect()))
    assert told(C.curve(counted, "score", "hit", "events")) == told(C.curve(rows, "score", "hit"))
