"""Low-and-slow exfiltration: network flows per destination, and daily reads against a baseline.

Events, after `normalize.exfil_events`: cloud_account, principal, src_ip,
src_uid, interface_uid, destination, entity_key, entity_type, event_time,
bytes_out, bytes_in, api_operation, api_service, user_agent, resource, log_source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from vigilia.functions import exprs as X
from vigilia.functions import fixed

FLOW_KEYS = ["cloud_account", "principal", "entity_key", "entity_type", "src_ip", "src_uid", "interface_uid", "destination"]
ENTITY_KEYS = ["cloud_account", "principal", "entity_key", "entity_type"]

joined_set = lambda c: F.array_join(F.array_sort(F.collect_set(c)), "|")


# Baseline and current part.


def split_at(events: DataFrame, cutoff: str) -> tuple[DataFrame, DataFrame]:
    at = F.lit(cutoff).cast("timestamp")
    return events.where(F.col("event_time") < at), events.where(F.col("event_time") >= at)


def _split_by(events: DataFrame, bound: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows = events.crossJoin(F.broadcast(bound))  # one row
    return rows.where(X.epoch_us("event_time") < F.col("_at")).drop("_at"), rows.where(X.epoch_us("event_time") >= F.col("_at")).drop("_at")


def split_last_days(events: DataFrame, days: int) -> tuple[DataFrame, DataFrame]:
    return _split_by(events, events.agg((F.max(X.epoch_us("event_time")) - days * 86_400_000_000).alias("_at")))


def split_share(events: DataFrame, share: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """The first part of the time range is the baseline; where all events have one time, everything is current."""
    us = X.epoch_us("event_time")
    bound = events.agg(F.min(us).alias("lo"), F.max(us).alias("hi")).select((F.col("lo") + F.floor((F.col("hi") - F.col("lo")) * share)).alias("_at"))
    return _split_by(events, bound)  # the latest event is never before the bound


# Rarity.


def with_rarity(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """Add rare_destination, rare_user_agent and rare_resource: whether the entity's baseline lacks the value."""
    out = current
    for column in ("destination", "user_agent", "resource"):
        seen = baseline.select("entity_key", column).distinct().withColumn(f"_{column}", F.lit(True))
        out = out.join(seen, ["entity_key", column], "left").withColumn(f"rare_{column}", F.col(f"_{column}").isNull()).drop(f"_{column}")
    return out


def entity_daily_p95(baseline: DataFrame) -> DataFrame:
    days = baseline.groupBy("entity_key", F.to_date("event_time").alias("d")).agg(F.sum("bytes_out").alias("b"), F.count("*").alias("n"))
    return days.groupBy("entity_key").agg(F.percentile("b", 0.95).alias("p95_bytes"), F.percentile("n", 0.95).alias("p95_events"))


# Network features.


def network_features(current: DataFrame) -> DataFrame:
    n, us = F.count("*"), X.epoch_us("event_time")
    share = lambda c: F.count_if(c) / n
    return current.where("bytes_out > 0").groupBy(*FLOW_KEYS).agg(
        F.min("event_time").alias("first_seen"), F.max("event_time").alias("last_seen"), F.sum("bytes_out").alias("total_bytes_out"), F.sum("bytes_in").alias("total_bytes_in"),
        n.alias("event_count"), F.avg("bytes_out").alias("avg_bytes_out"), F.median("bytes_out").alias("median_bytes_out"), F.max("bytes_out").alias("max_bytes_out"),
        F.count_if(F.col("bytes_out") <= fixed.SMALL_TRANSFER).alias("small_transfer_count"), F.count_if("rare_destination").alias("rare_destination_event_count"),
        F.count_if("rare_user_agent").alias("rare_user_agent_event_count"), F.countDistinct("user_agent").alias("distinct_user_agents"), joined_set("log_source").alias("log_sources"),
        ((F.max(us) - F.min(us)) / 3600e6).alias("duration_hours"), share(F.col("bytes_out") <= fixed.SMALL_TRANSFER).alias("small_transfer_ratio"),
        share(F.col("rare_destination")).alias("rare_destination_ratio"), share(F.col("rare_user_agent")).alias("rare_user_agent_ratio"),
    )


def timing_features(current: DataFrame, tie: str = "event_uid") -> DataFrame:
    """Inter-arrival seconds per flow key: moments, their variation, and the share within the band around their median."""
    order = W.partitionBy(*FLOW_KEYS).orderBy("event_time", tie)
    us = X.epoch_us("event_time")
    deltas = current.where("bytes_out > 0").withColumn("_d", (us - F.lag(us).over(order)) / 1e6).where("_d IS NOT NULL")
    middle = deltas.groupBy(*FLOW_KEYS).agg(F.median("_d").alias("_m")).select(*(F.col(k).alias(f"_{k}") for k in FLOW_KEYS), "_m")
    same = F.lit(True)
    for k in FLOW_KEYS:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    deltas = deltas.join(middle, same)
    inside = F.when(F.col("_m") > 0, F.col("_d").between(F.col("_m") * (1 - fixed.BAND), F.col("_m") * (1 + fixed.BAND)).cast("double"))
    out = deltas.groupBy(*FLOW_KEYS).agg(
        F.avg("_d").alias("mean_interval_seconds"), F.stddev_samp("_d").alias("std_interval_seconds"), F.first("_m").alias("median_interval_seconds"),
        F.min("_d").alias("min_interval_seconds"), F.max("_d").alias("max_interval_seconds"), F.count("*").alias("interval_count"), F.avg(inside).alias("interval_median_band_ratio"),
    )
    return out.withColumn("interval_cv", F.col("std_interval_seconds") / F.nullif(F.col("mean_interval_seconds"), F.lit(0.0)))


#: Operations (lower case) of an object store, of object reads and of listings, as patterns.
STORE_PATTERN = "getobject|listbucket|get.object|get.bucket|rest.get"
STORE_NAMES = ["getobject", "listbucket", "get object", "list bucket", "rest.get.object", "rest.get.bucket"]
READ_PATTERN = "getobject|get object|get.object|rest.get.object"
LIST_PATTERN = "listbucket|list bucket|get.bucket|rest.get.bucket"
DOWNLOAD_PATTERN = "download|read"


def is_store_event() -> Column:
    op, service = F.lower("api_operation"), F.lower("api_service")
    return F.coalesce(service.contains("s3"), F.lit(False)) | F.coalesce(op.isin(STORE_NAMES) | op.rlike(STORE_PATTERN), F.lit(False))


def is_store_read() -> Column:
    op = F.lower("api_operation")
    source = F.coalesce(F.lower("api_service").contains("s3"), F.lit(False)) | F.coalesce(F.lower("log_source").contains("s3"), F.lit(False))
    return source & F.coalesce(op.rlike(READ_PATTERN) | op.rlike(DOWNLOAD_PATTERN), F.lit(False))


def store_features(current: DataFrame) -> DataFrame:
    op, us = F.lower("api_operation"), X.epoch_us("event_time")
    return current.where(is_store_event()).groupBy("cloud_account", "principal", "entity_key").agg(
        F.min("event_time").alias("first_s3_seen"), F.max("event_time").alias("last_s3_seen"), F.count("api_operation").alias("s3_event_count"),
        F.count_if(op.rlike(READ_PATTERN)).alias("get_object_count"), F.count_if(op.rlike(LIST_PATTERN)).alias("list_bucket_count"),
        F.countDistinct("resource").alias("distinct_resources"), F.count_if("rare_resource").alias("rare_resource_event_count"),
        joined_set("log_source").alias("s3_log_sources"), ((F.max(us) - F.min(us)) / 3600e6).alias("s3_duration_hours"),
    )


def join_features(network: DataFrame, timing: DataFrame, store: DataFrame) -> DataFrame:
    """Flow keys with their timing (null where there are fewer than two flows) and their entity's object access (0 where there is none)."""
    out = network.join(timing, FLOW_KEYS, "left").join(store, ["cloud_account", "principal", "entity_key"], "left")
    return out.na.fill(0, ["s3_event_count", "get_object_count", "list_bucket_count", "distinct_resources", "rare_resource_event_count", "interval_count"])


def score_network(features: DataFrame, p95: DataFrame) -> DataFrame:
    """Add network_risk_score (0 to 100), the scores' aliases and alert_reasons. The period's totals are held against the daily p95."""
    c = F.col
    rows = features.join(p95, "entity_key", "left").na.fill(0.0, ["p95_bytes", "p95_events"])
    whole = lambda x: c(x).cast("long").cast("string")
    regular = c("interval_cv").isNotNull() & (c("interval_count") >= fixed.MIN_INTERVALS) & (c("interval_cv") <= fixed.REGULAR_CV)
    jittered = c("interval_cv").isNotNull() & (c("interval_count") >= fixed.MIN_INTERVALS) & (c("interval_cv") <= fixed.JITTERED_CV) & F.coalesce(c("interval_median_band_ratio") >= fixed.MIN_BAND_RATIO, F.lit(False))
    rules = [
        (c("event_count") >= fixed.MIN_EVENTS, 15, F.concat(F.lit("high repeated event count: "), whole("event_count"))),
        (c("small_transfer_ratio") >= fixed.MIN_SMALL_RATIO, 15, F.format_string("mostly small transfers: %.2f", c("small_transfer_ratio"))),
        (c("duration_hours") >= fixed.MIN_HOURS, 10, F.format_string("spread over %.1f hours", c("duration_hours"))),
        (c("total_bytes_out") >= fixed.MIN_TOTAL_BYTES, 20, F.concat(F.lit("meaningful accumulated egress: "), whole("total_bytes_out"), F.lit(" bytes"))),
        ((c("p95_bytes") > 0) & (c("total_bytes_out") > c("p95_bytes")), 15, F.concat(F.lit("bytes_out above entity daily p95 baseline: "), whole("p95_bytes"))),
        ((c("p95_events") > 0) & (c("event_count") > c("p95_events")), 10, F.concat(F.lit("event_count above entity daily p95 baseline: "), whole("p95_events"))),
        (c("rare_destination_ratio") >= 0.5, 20, F.lit("destination is new/rare for this entity")),
        (c("rare_user_agent_ratio") >= 0.5, 10, F.lit("user agent is new/rare for this entity")),
        (regular, 15, F.format_string("regular timing pattern, interval_cv=%.2f", c("interval_cv"))),
        (~regular & jittered, 15, F.format_string(
            "jittered regular timing pattern: median_interval=%.1f min, interval_cv=%.2f, %.0f%% within +/-" + f"{fixed.BAND:.0%}".replace("%", "%%") + " of median",
            c("median_interval_seconds") / 60, c("interval_cv"), c("interval_median_band_ratio") * 100,
        )),
        (c("get_object_count") >= 50, 15, F.concat(F.lit("many S3 GetObject-like events: "), whole("get_object_count"))),
        (c("distinct_resources") >= 50, 15, F.concat(F.lit("many distinct resources accessed: "), whole("distinct_resources"))),
        (c("rare_resource_event_count") >= 10, 10, F.concat(F.lit("many rare resource accesses: "), whole("rare_resource_event_count"))),
    ]
    score = X.normalize_score(X.points(*((h, p) for h, p, _ in rules)), fixed.NETWORK_MAX)
    return rows.withColumns({
        "alert_family": F.lit("network"), "alert_type": F.lit("possible_low_and_slow_exfiltration"), "network_risk_score": score, "time_based_risk_score": F.lit(0.0),
        "combined_risk_score": score, "risk_score": score, "alert_reasons": X.reasons(*((h, t) for h, _, t in rules)),
    })


# Daily reads.


def daily_reads(events: DataFrame) -> DataFrame:
    """Object reads per entity and day; volume is the greater of bytes in and out, neither below 0. Needs rare_resource."""
    volume = F.greatest(F.greatest("bytes_out", F.lit(0)), F.greatest("bytes_in", F.lit(0)))
    return events.where(is_store_read()).groupBy(*ENTITY_KEYS, F.to_date("event_time").alias("access_day")).agg(
        F.sum(volume).alias("daily_s3_read_bytes"), F.count("*").alias("daily_s3_read_events"), F.countDistinct("resource").alias("daily_distinct_resources"),
        F.count_if("rare_resource").alias("daily_rare_resource_events"), F.min("event_time").alias("first_seen"), F.max("event_time").alias("last_seen"), joined_set("log_source").alias("log_sources"),
    )


def time_baseline(daily: DataFrame) -> DataFrame:
    b, n = F.col("daily_s3_read_bytes"), F.col("daily_s3_read_events")
    return daily.groupBy(*ENTITY_KEYS).agg(
        F.countDistinct("access_day").alias("baseline_days"), F.avg(b).alias("baseline_avg_daily_bytes"), F.percentile(b, 0.95).alias("baseline_p95_daily_bytes"),
        F.coalesce(F.stddev_samp(b), F.lit(0.0)).alias("baseline_std_daily_bytes"), F.avg(n).alias("baseline_avg_daily_events"), F.percentile(n, 0.95).alias("baseline_p95_daily_events"),
        F.sum(b).alias("baseline_total_bytes"), F.sum(n).alias("baseline_total_events"),
    )


def activity_ratios(daily: DataFrame, baseline: DataFrame) -> DataFrame:
    """Current days of entities with a baseline, with bytes, event and activity ratio (the greater; null if neither exists)."""
    rows = daily.join(baseline, ENTITY_KEYS).where("baseline_days > 0")
    rows = rows.withColumns({
        "bytes_ratio": X.safe_ratio(F.col("daily_s3_read_bytes"), F.col("baseline_avg_daily_bytes")), "event_ratio": X.safe_ratio(F.col("daily_s3_read_events"), F.col("baseline_avg_daily_events")),
    })
    return rows.withColumn("activity_ratio", F.greatest("bytes_ratio", "event_ratio"))


def time_features(ratios: DataFrame) -> DataFrame:
    """One row per entity: counts of elevated and spike days, early and final means, slope, totals against what the baseline lets expect, and the days as evidence.

    An entity's days are one array (as many elements as days), so the evidence
    is built inside the row.
    """
    c, x = F.col, F.coalesce(F.col("activity_ratio"), F.lit(0.0))
    early = W.partitionBy(*ENTITY_KEYS).orderBy("access_day")
    late = W.partitionBy(*ENTITY_KEYS).orderBy(F.desc("access_day"))
    rows = ratios.withColumns({"_x": x, "_early": F.row_number().over(early), "_late": F.row_number().over(late), "_day": F.datediff("access_day", F.lit("1970-01-01"))})
    d = lambda name: F.round(F.coalesce(F.col(name), F.lit(0.0)), 2)
    flags = X.compact(
        F.when(c("_x") >= fixed.SUSTAINED_RATIO, "elevated"), F.when(c("_x") >= fixed.SPIKE_RATIO, "spike"), F.when(c("daily_rare_resource_events") > 0, "rare_resources"),
    )
    day = F.struct(
        F.date_format("access_day", "yyyy-MM-dd").alias("date"), d("activity_ratio").alias("activity_ratio"), d("bytes_ratio").alias("bytes_ratio"), d("event_ratio").alias("event_ratio"),
        c("daily_s3_read_bytes").cast("long").alias("bytes"), c("baseline_avg_daily_bytes").cast("long").alias("expected_bytes"),
        F.greatest(F.lit(0.0), c("daily_s3_read_bytes") - c("baseline_avg_daily_bytes")).cast("long").alias("excess_bytes"), c("daily_s3_read_events").alias("events"),
        F.round("baseline_avg_daily_events", 2).alias("expected_events"), c("daily_distinct_resources").alias("distinct_resources"), c("daily_rare_resource_events").alias("rare_resource_events"), flags.alias("flags"),
    )
    us = lambda e: F.unix_micros(e)
    out = rows.groupBy(*ENTITY_KEYS).agg(
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.first("baseline_days").alias("baseline_days"), F.countDistinct("access_day").alias("current_days"),
        F.count_if(c("_x") >= fixed.SUSTAINED_RATIO).alias("elevated_days"), F.count_if(c("_x") >= fixed.SPIKE_RATIO).alias("spike_days"),
        F.first("baseline_avg_daily_bytes").alias("baseline_avg_daily_bytes"), F.first("baseline_p95_daily_bytes").alias("baseline_p95_daily_bytes"), F.first("baseline_avg_daily_events").alias("baseline_avg_daily_events"),
        F.sum("daily_s3_read_bytes").alias("total_current_bytes"), F.sum("daily_s3_read_events").alias("total_current_events"), F.avg("_x").alias("avg_activity_ratio"), F.max("_x").alias("max_activity_ratio"),
        F.avg(F.when(c("_early") <= 3, c("_x"))).alias("early3_avg_ratio"), F.avg(F.when(c("_late") <= 3, c("_x"))).alias("final3_avg_ratio"),
        F.coalesce(F.regr_slope("_x", "_day"), F.lit(0.0)).alias("trend_slope_ratio_per_day"), F.sum("daily_distinct_resources").alias("total_distinct_resource_day_count"),
        F.sum("daily_rare_resource_events").alias("rare_resource_event_count"), joined_set("log_sources").alias("log_sources"), F.array_sort(F.collect_list(day)).alias("days"),
    )
    out = out.withColumns({
        "duration_days": F.greatest(F.lit(1), F.datediff("last_seen", "first_seen") + 1), "duration_hours": (us(c("last_seen").cast("timestamp")) - us(c("first_seen").cast("timestamp"))) / 3600e6,
        "expected_current_bytes": c("baseline_avg_daily_bytes") * c("current_days"), "expected_current_events": c("baseline_avg_daily_events") * c("current_days"),
    })
    out = out.withColumns({
        "cumulative_excess_bytes": c("total_current_bytes") - c("expected_current_bytes"), "cumulative_ratio": X.safe_ratio(c("total_current_bytes"), c("expected_current_bytes")),
        "cumulative_event_ratio": X.safe_ratio(c("total_current_events"), c("expected_current_events")),
    })
    return with_time_evidence(out)


def with_time_evidence(features: DataFrame) -> DataFrame:
    """Add the contributing days and the texts about them. The earliest of equally active days comes first."""
    days = F.col("days")
    flagged = lambda f: F.filter(days, lambda d: F.array_contains(d["flags"], f))
    dates = lambda a: F.transform(a, lambda d: d["date"])
    ranked = F.transform(F.sort_array(F.transform(days, lambda d: F.struct((-d["activity_ratio"]).alias("r"), d["date"].alias("date")))), lambda s: F.struct(s["date"].alias("date"), (-s["r"]).alias("activity_ratio")))
    out = features.withColumns({
        "_elevated": dates(flagged("elevated")), "_spike": dates(flagged("spike")), "_final": dates(F.slice(days, F.greatest(F.size(days) - 2, F.lit(1)), 3)), "_top": F.slice(ranked, 1, 5),
    })
    ramp = F.col("final3_avg_ratio") >= fixed.RAMP_FINAL
    none = F.array().cast("array<string>")
    named = F.array_union(F.array_union("_elevated", "_spike"), F.array_union(F.when(ramp, F.col("_final")).otherwise(none), dates(F.slice("_top", 1, 3))))
    out = out.withColumn("_contributing", F.filter(days, lambda d: F.array_contains(named, d["date"])))
    listed = lambda name, label: F.when(F.size(name) > 0, F.concat(F.size(name).cast("string"), F.lit(f" {label} day(s): "), F.array_join(F.slice(name, 1, 8), ", ")))
    top = F.get("_top", F.lit(0))
    summary = F.concat_ws(
        "; ", listed("_elevated", "elevated"), listed("_spike", "spike"), F.when(ramp, F.concat(F.lit("final 3-day window stayed high: "), F.array_join("_final", ", "))),
        F.concat(F.lit("peak day "), top["date"], F.format_string(" reached %.2fx baseline", top["activity_ratio"])),
    )
    return out.withColumns({
        "contributing_day_count": F.size("_contributing"), "contributing_days": F.array_join(dates(F.col("_contributing")), "|"), "elevated_day_dates": F.array_join("_elevated", "|"),
        "spike_day_dates": F.array_join("_spike", "|"), "final_window_days": F.array_join("_final", "|"),
        "top_activity_days": F.array_join(F.transform("_top", lambda d: F.concat(d["date"], F.format_string(":%.2fx", d["activity_ratio"]))), "|"),
        "time_evidence_summary": summary, "daily_evidence_json": F.to_json("days"), "contributing_day_evidence_json": F.to_json("_contributing"),
    }).drop("_elevated", "_spike", "_final", "_top", "_contributing", "days")


def score_time(features: DataFrame) -> DataFrame:
    """Add time_based_risk_score, detection types and reasons."""
    c = F.col
    whole = lambda x: c(x).cast("long").cast("string")
    days = c("current_days")
    sustained = (days >= fixed.SUSTAINED_DAYS) & (c("elevated_days") >= fixed.SUSTAINED_DAYS) & (c("avg_activity_ratio") >= fixed.SUSTAINED_RATIO)
    final, first, slope = c("final3_avg_ratio"), c("early3_avg_ratio"), c("trend_slope_ratio_per_day")
    ramp = (days >= 7) & (slope >= fixed.RAMP_SLOPE) & (final >= fixed.RAMP_FINAL) & (final > F.greatest(first * 1.5, first + 0.75))
    periodic = (days >= 7) & (c("spike_days") >= fixed.SPIKE_DAYS) & (c("spike_days") < days) & (c("max_activity_ratio") >= fixed.SPIKE_RATIO)
    beyond = F.coalesce(c("cumulative_ratio") >= fixed.CUMULATIVE_RATIO, F.lit(False)) | F.coalesce(c("cumulative_event_ratio") >= fixed.CUMULATIVE_RATIO, F.lit(False))
    cumulative = beyond & (c("cumulative_excess_bytes") >= fixed.MIN_TOTAL_BYTES)
    rules = [
        (sustained, 40, F.concat(F.lit("sustained elevation: "), whole("elevated_days"), F.lit("/"), whole("current_days"), F.lit(f" days >= {fixed.SUSTAINED_RATIO:.1f}x baseline"))),
        (c("avg_activity_ratio") >= fixed.SUSTAINED_RATIO, 15, F.format_string("average incident activity is %.2fx baseline", c("avg_activity_ratio"))),
        (ramp, 35, F.format_string("ramping increase: slope=%.2f ratio/day, early3=%.2fx, final3=%.2fx", slope, first, final)),
        (final >= fixed.RAMP_FINAL, 15, F.format_string("final 3-day average is %.2fx baseline", final)),
        (periodic, 35, F.concat(F.lit("periodic/repeated spikes: "), whole("spike_days"), F.lit(f" days >= {fixed.SPIKE_RATIO:.1f}x baseline"))),
        (cumulative, 25, F.concat(F.lit("cumulative excess: "), whole("cumulative_excess_bytes"), F.lit(" bytes over expected baseline"))),
        (c("total_distinct_resource_day_count") >= 50, 10, F.concat(F.lit("broad resource access over time: "), whole("total_distinct_resource_day_count"), F.lit(" resource-days"))),
        (c("rare_resource_event_count") >= 10, 10, F.concat(F.lit("rare resource accesses over time: "), whole("rare_resource_event_count"))),
        (days >= 10, 5, F.concat(F.lit("long observation window: "), whole("current_days"), F.lit(" active days"))),
    ]
    kinds = F.concat_ws("|", F.when(sustained, "sustained_elevation"), F.when(ramp, "ramp_up"), F.when(periodic, "periodic_spikes"), F.when(cumulative, "cumulative_excess"))
    score = X.normalize_score(X.points(*((h, p) for h, p, _ in rules)), fixed.TIME_MAX)
    absent = F.lit("not_applicable_time_based")
    return features.withColumns({
        "alert_family": F.lit("time_based"), "alert_type": F.lit("time_based_low_and_slow_exfiltration"), "src_ip": absent, "src_uid": absent, "interface_uid": absent,
        "destination": F.lit("s3_data_access_time_series"), "time_based_risk_score": score, "network_risk_score": F.lit(0.0), "combined_risk_score": score, "risk_score": score,
        "alert_reasons": X.reasons(*((h, t) for h, _, t in rules)), "time_detection_types": F.when(kinds == "", F.lit("time_anomaly_weak_signal")).otherwise(kinds),
    })


def detect(events: DataFrame, cutoff: str, min_score: float = 0.0, tie: str = "event_uid") -> DataFrame:
    """All alerts of both layers with at least `min_score`. Either layer may be empty."""
    baseline, current = split_at(events, cutoff)
    marked = with_rarity(current, baseline)
    network = score_network(join_features(network_features(marked), timing_features(marked, tie), store_features(marked)), entity_daily_p95(baseline)).where(F.col("network_risk_score") >= min_score)
    before = daily_reads(baseline.withColumn("rare_resource", F.lit(False)))
    time = score_time(time_features(activity_ratios(daily_reads(marked), time_baseline(before)))).where(F.col("time_based_risk_score") >= min_score)
    return network.unionByName(time, allowMissingColumns=True)


def ordered_alerts(alerts: DataFrame) -> DataFrame:
    return alerts.orderBy(F.desc("combined_risk_score"), F.desc("time_based_risk_score"), F.desc("network_risk_score"), "entity_key", "destination")
