"""Exfiltration: every rule at, under and over its bound, rarity, daily series and evidence."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from vigilia.functions import fixed
from vigilia.operators import exfil as E

BASE = dict(
    event_count=1, small_transfer_ratio=0.0, duration_hours=0.0, total_bytes_out=1, rare_destination_ratio=0.0, rare_user_agent_ratio=0.0, interval_cv=None, interval_count=0,
    interval_median_band_ratio=None, median_interval_seconds=60.0, get_object_count=0, distinct_resources=0, rare_resource_event_count=0, entity_key="e",
)
SCHEMA = (
    "event_count long, small_transfer_ratio double, duration_hours double, total_bytes_out long, rare_destination_ratio double, rare_user_agent_ratio double, interval_cv double, interval_count long, "
    "interval_median_band_ratio double, median_interval_seconds double, get_object_count long, distinct_resources long, rare_resource_event_count long, entity_key string"
)


@pytest.mark.parametrize("change, points", [
    ({"event_count": 20}, 15), ({"event_count": 19}, 0), ({"small_transfer_ratio": 0.8}, 15), ({"small_transfer_ratio": 0.79}, 0), ({"duration_hours": 6.0}, 10), ({"duration_hours": 5.99}, 0),
    ({"total_bytes_out": fixed.MIN_TOTAL_BYTES}, 20), ({"total_bytes_out": fixed.MIN_TOTAL_BYTES - 1}, 0), ({"entity_key": "known", "total_bytes_out": 101}, 15), ({"entity_key": "known", "total_bytes_out": 100}, 0),
    ({"entity_key": "known", "event_count": 6}, 10), ({"entity_key": "known", "event_count": 5}, 0), ({"rare_destination_ratio": 0.5}, 20), ({"rare_user_agent_ratio": 0.5}, 10),
    ({"interval_cv": 0.25, "interval_count": 10}, 15), ({"interval_cv": 0.25, "interval_count": 9}, 0), ({"interval_cv": 0.35, "interval_count": 10, "interval_median_band_ratio": 0.8}, 15),
    ({"interval_cv": 0.35, "interval_count": 10, "interval_median_band_ratio": 0.79}, 0), ({"interval_cv": 0.36, "interval_count": 10, "interval_median_band_ratio": 1.0}, 0),
    ({"get_object_count": 50}, 15), ({"distinct_resources": 50}, 15), ({"rare_resource_event_count": 10}, 10),
])
def test_network_rules(spark, change, points):
    rows = spark.createDataFrame([tuple((BASE | change).values())], SCHEMA)
    p95 = spark.createDataFrame([("known", 100.0, 5.0)], "entity_key string, p95_bytes double, p95_events double")
    row = E.score_network(rows, p95).first()
    assert row.network_risk_score == pytest.approx(round(points / 170 * 100, 2), abs=0.006) and (row.alert_reasons == "") == (points == 0)


TIME = dict(current_days=1, elevated_days=0, spike_days=0, avg_activity_ratio=0.0, max_activity_ratio=0.0, final3_avg_ratio=0.0, early3_avg_ratio=0.0, trend_slope_ratio_per_day=0.0, cumulative_ratio=None, cumulative_event_ratio=None, cumulative_excess_bytes=0.0, total_distinct_resource_day_count=0, rare_resource_event_count=0)
TIME_SCHEMA = "current_days long, elevated_days long, spike_days long, avg_activity_ratio double, max_activity_ratio double, final3_avg_ratio double, early3_avg_ratio double, trend_slope_ratio_per_day double, cumulative_ratio double, cumulative_event_ratio double, cumulative_excess_bytes double, total_distinct_resource_day_count long, rare_resource_event_count long"


@pytest.mark.parametrize("change, points, kinds", [
    ({}, 0, "time_anomaly_weak_signal"), ({"current_days": 7, "elevated_days": 7, "avg_activity_ratio": 2.5}, 55, "sustained_elevation"), ({"current_days": 7, "elevated_days": 6, "avg_activity_ratio": 2.5}, 15, "time_anomaly_weak_signal"),
    ({"current_days": 7, "trend_slope_ratio_per_day": 0.12, "final3_avg_ratio": 3.0, "early3_avg_ratio": 1.9}, 50, "ramp_up"), ({"current_days": 7, "trend_slope_ratio_per_day": 0.12, "final3_avg_ratio": 3.0, "early3_avg_ratio": 2.0}, 15, "time_anomaly_weak_signal"),
    ({"current_days": 7, "trend_slope_ratio_per_day": 0.11, "final3_avg_ratio": 3.0}, 15, "time_anomaly_weak_signal"), ({"current_days": 7, "spike_days": 4, "max_activity_ratio": 4.0}, 35, "periodic_spikes"),
    ({"current_days": 7, "spike_days": 7, "max_activity_ratio": 4.0}, 0, "time_anomaly_weak_signal"), ({"cumulative_event_ratio": 2.0, "cumulative_excess_bytes": float(fixed.MIN_TOTAL_BYTES)}, 25, "cumulative_excess"),
    ({"cumulative_ratio": 1.99, "cumulative_excess_bytes": float(fixed.MIN_TOTAL_BYTES)}, 0, "time_anomaly_weak_signal"), ({"total_distinct_resource_day_count": 50}, 10, "time_anomaly_weak_signal"), ({"rare_resource_event_count": 10}, 10, "time_anomaly_weak_signal"),
    ({"current_days": 10}, 5, "time_anomaly_weak_signal"),
])
def test_time_rules(spark, change, points, kinds):
    row = E.score_time(spark.createDataFrame([tuple((TIME | change).values())], TIME_SCHEMA)).first()
    assert row.time_based_risk_score == pytest.approx(round(points / 155 * 100, 2), abs=0.006) and row.time_detection_types == kinds


def flows(spark, rows):
    """rows: (hour, destination, bytes)."""
    at = dt.datetime(2024, 1, 1)
    data = [("acct", "p", "principal:acct:p", "principal", "ip", "s", "i", d, at + dt.timedelta(hours=h), n, b, 0, "GetObject", "s3.amazonaws.com", "ua", f"r{n % 3}", "s3_access") for n, (h, d, b) in enumerate(rows)]
    return spark.createDataFrame(data, "cloud_account string, principal string, entity_key string, entity_type string, src_ip string, src_uid string, interface_uid string, destination string, event_time timestamp, event_uid long, bytes_out long, bytes_in long, api_operation string, api_service string, user_agent string, resource string, log_source string")


def test_beacon_and_band(spark):
    rows = flows(spark, [(i, "c2", 10) for i in range(11)] + [(0, "once", 5), (3, "zero", 0)]).withColumn("rare_destination", F.lit(True)).withColumn("rare_user_agent", F.lit(False))
    got = {r.destination: r for r in E.timing_features(rows).collect()}
    assert set(got) == {"c2"} and got["c2"].interval_count == 10 and got["c2"].interval_cv == 0 and got["c2"].interval_median_band_ratio == 1 and got["c2"].mean_interval_seconds == 3600
    assert {r.destination for r in E.network_features(rows).collect()} == {"c2", "once"}


def test_equal_times_have_no_band(spark):
    rows = flows(spark, [(1, "d", 5), (1, "d", 5)])
    row = E.timing_features(rows).first()
    assert row.interval_median_band_ratio is None and row.interval_cv is None


def test_rarity_and_p95(spark):
    before, after = E.split_at(flows(spark, [(0, "a", 1), (30, "a", 2), (60, "a", 3), (90, "a", 10), (200, "a", 1), (200, "b", 1)]), "2024-01-06")
    assert {r.destination: r.rare_destination for r in E.with_rarity(after, before).collect()} == {"a": False, "b": True}
    assert E.entity_daily_p95(before).first().p95_bytes == pytest.approx(8.95)


def test_daily_series_and_evidence(spark):
    base = flows(spark, [(24 * d, "x", 100) for d in range(10)]).withColumn("rare_resource", F.lit(False))
    now = flows(spark, [(24 * (20 + d), "x", 100 * m) for d, m in enumerate([1, 1, 1, 3, 3, 5, 5, 5])]).withColumn("rare_resource", F.lit(True))
    row = E.score_time(E.time_features(E.activity_ratios(E.daily_reads(now), E.time_baseline(E.daily_reads(base))))).first()
    assert (row.current_days, row.elevated_days, row.spike_days, row.baseline_days) == (8, 5, 3, 10)
    assert row.early3_avg_ratio == 1 and row.final3_avg_ratio == 5 and row.duration_days == 8 and row.trend_slope_ratio_per_day == pytest.approx(0.7142857)
    assert "ramp_up" in row.time_detection_types and row.spike_day_dates == "2024-01-26|2024-01-27|2024-01-28" == row.final_window_days
    assert row.top_activity_days.startswith("2024-01-26:5.00x|2024-01-27:5.00x") and "peak day 2024-01-26 reached 5.00x baseline" in row.time_evidence_summary
    assert row.contributing_day_count == 5 and '"flags":["elevated","spike","rare_resources"]' in row.daily_evidence_json


def test_splits_and_detect(spark):
    rows = flows(spark, [(24 * d, "x", 100) for d in range(11)])
    assert [f.count() for f in E.split_last_days(rows, 3)] == [7, 4] and [f.count() for f in E.split_share(rows)] == [7, 4]
    assert [f.count() for f in E.split_share(rows.limit(1))] == [0, 1]
    alerts = E.ordered_alerts(E.detect(rows, "2024-01-08")).collect()
    assert {a.alert_family for a in alerts} == {"network", "time_based"} and E.detect(rows.limit(0), "2024-01-08").count() == 0
