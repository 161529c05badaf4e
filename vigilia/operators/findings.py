"""Findings: the detectors' results per actor, and tables over a period.

Scores: (day, actor, final_score, api_score, access_score, flow_score, ...).
Alerts: entity_key, network_risk_score, time_based_risk_score, destination, and
principal or interface_uid. Sessions: identity_id, session_risk_score.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from vigilia.functions import exprs as X
from vigilia.functions import fixed
from vigilia.operators.baseline import long_values


def peak_scores(scores: DataFrame) -> DataFrame:
    """(actor, ueba_peak, peak_day): the best day above 0, the earliest of equals; actors that never score are left out."""
    order = W.partitionBy("actor").orderBy(F.desc("final_score"), "day")
    return scores.where("final_score > 0").withColumn("_r", F.row_number().over(order)).where("_r = 1").select("actor", F.col("final_score").alias("ueba_peak"), F.col("day").alias("peak_day"))


def alert_actor(alerts: DataFrame, interfaces: DataFrame | None = None) -> DataFrame:
    """Add `actor`: the principal, else who is behind the interface, else the interface."""
    principal = F.when(X.is_meaningful("principal"), F.col("principal"))
    eni = F.when(X.is_meaningful("interface_uid"), F.col("interface_uid"))
    if interfaces is None:
        return alerts.withColumn("actor", F.coalesce(principal, eni, F.lit("unknown")))
    known = interfaces.select(F.col("eni").alias("interface_uid"), F.col("actor").alias("_behind"))
    return alerts.join(known, "interface_uid", "left").withColumn("actor", F.coalesce(principal, "_behind", eni, F.lit("unknown"))).drop("_behind")


def latest_interfaces(daily: DataFrame) -> DataFrame:
    """(eni, actor) from (day, eni, actor) rows of all days: who was behind an interface on the latest day that tells, of several the least name."""
    each = daily.where("eni IS NOT NULL AND actor IS NOT NULL").groupBy("eni", "day").agg(F.min("actor").alias("actor"))
    return each.groupBy("eni").agg(F.max_by("actor", "day").alias("actor"))


def ranked_alerts(alerts: DataFrame, score: str, family: str, keep: int | None = None) -> DataFrame:
    """The alerts of a family with their place among the actor's, the highest score first; the first `keep` of each actor where it is given."""
    turn = W.partitionBy("actor").orderBy(F.desc(score), "entity_key", "destination")
    out = alerts.where(F.col("alert_family") == family).withColumn("place", F.row_number().over(turn))
    return out if keep is None else out.where(F.col("place") <= keep)


def findings_matrix(scores: DataFrame, alerts: DataFrame, sessions: DataFrame | None, top_sessions: int = fixed.TOP_SESSIONS) -> DataFrame:
    """One row per actor of any detector, with the count of signals at their thresholds; most signals first."""
    peak = peak_scores(scores)
    exfil = alerts.groupBy("actor").agg(F.max("network_risk_score").alias("network_max"), F.max("time_based_risk_score").alias("time_max"))
    out = peak.join(exfil, "actor", "full_outer")
    signals = [("ueba_peak", fixed.UEBA_ALERT), ("network_max", fixed.EXFIL_ALERT), ("time_max", fixed.EXFIL_ALERT)]
    if sessions is not None:
        top = sessions.orderBy(F.desc("session_risk_score"), "session_id").limit(top_sessions)
        out = out.join(top.groupBy(F.col("identity_id").alias("actor")).agg(F.max("session_risk_score").alias("session_max")), "actor", "full_outer")
        signals.append(("session_max", fixed.SESSION_ALERT))
    out = out.na.fill(0.0, [n for n, _ in signals])
    count = F.lit(0)
    for name, least in signals:
        count = count + (F.col(name) >= least).cast("int")
    best = F.greatest("ueba_peak", *(F.col(n) / 100 for n, _ in signals[1:]))
    return out.withColumns({"signals": count, "signals_of": F.lit(len(signals)), "best": best}).orderBy(F.desc("signals"), F.desc("best"), "actor")


def score_trend(scores: DataFrame, days: list[str]) -> DataFrame:
    """A column per day, and the peak."""
    wide = scores.groupBy("actor").pivot("day", days).agg(F.first("final_score"))
    return wide.join(scores.groupBy("actor").agg(F.max("final_score").alias("peak")), "actor")


def peak_day_signals(scores: DataFrame, dimensions: dict[str, DataFrame]) -> DataFrame:
    """(actor, peak_day, source, dimension, value): what fired on each actor's peak day, strongest first within a source."""
    peak = peak_scores(scores).select("actor", F.col("peak_day").alias("day"))
    out = None
    for source, frame in dimensions.items():
        names = [c for c in frame.columns if c not in ("actor", "day")]
        long = frame.join(peak, ["actor", "day"]).unpivot(["actor", "day"], names, "dimension", "value").where("value > 0").withColumn("source", F.lit(source))
        out = long if out is None else out.unionByName(long)
    return out.select("actor", F.col("day").alias("peak_day"), "source", "dimension", "value")


def period_anomalies(items: DataFrame, known: DataFrame) -> DataFrame:
    """(actor, kind, item, first_day) of items that the actor's baseline lacks; actors without any baseline are hidden."""
    first = items.groupBy("actor", "kind", "item").agg(F.min("day").alias("first_day"))
    return first.join(known.select("actor").distinct(), "actor", "left_semi").join(known, ["actor", "kind", "item"], "left_anti")


def exfil_by_actor(alerts: DataFrame) -> DataFrame:
    """(actor, network_alerts, destinations, network_max, time_max, best_time_entity)."""
    time = F.col("alert_family") == "time_based"
    return alerts.groupBy("actor").agg(
        F.count_if(~time).alias("network_alerts"), F.countDistinct(F.when(~time, F.col("destination"))).alias("destinations"), F.max("network_risk_score").alias("network_max"),
        F.max("time_based_risk_score").alias("time_max"), F.max_by(F.when(time, F.col("entity_key")), F.when(time, F.struct("time_based_risk_score", "entity_key"))).alias("best_time_entity"),
    )


def evidence_rows(today: DataFrame, before: DataFrame) -> DataFrame:
    """(actor, kind, value, n, first_seen) of today's values that the actor's baseline lacks, all of them for actors without one. Inputs are long rows (actor, kind, value, event_time), so no set is ever one row."""
    rows = today.where(F.col("value").isNotNull()).groupBy("actor", "kind", "value").agg(F.count("*").alias("n"), F.min("event_time").alias("first_seen"))
    return rows.join(before.select("actor", "kind", "value").distinct(), ["actor", "kind", "value"], "left_anti")


def api_evidence(events: DataFrame) -> DataFrame:
    """Long rows of operations, addresses, regions and resources."""
    return _long(events, {"operation": "operation", "ip": "ip", "region": "region"}).unionByName(
        events.select("actor", F.lit("resource").alias("kind"), F.explode("resources").alias("value"), "event_time")
    )


def access_evidence(accesses: DataFrame) -> DataFrame:
    """Long rows of operations, addresses and buckets."""
    return _long(accesses, {"operation": "operation", "ip": "ip", "bucket": "bucket"})


def flow_evidence(flows: DataFrame) -> DataFrame:
    """Long rows of destinations, connections (address:port) and protocols."""
    rows = flows.withColumn("connection", F.concat_ws(":", "dst_ip", F.col("dst_port").cast("string")))
    return _long(rows, {"dst_ip": "dst_ip", "connection": "connection", "protocol": "protocol"})


def _long(rows: DataFrame, kinds: dict[str, str]) -> DataFrame:
    return long_values(rows, kinds, ["actor", "event_time"]).select("actor", "kind", "value", "event_time")


def new_evidence(today: DataFrame, before: DataFrame, columns: list[str]) -> DataFrame:
    """(actor, column, items): what today's sets have beyond the baseline's; all of it for actors without one."""
    prior = before.select("actor", *(F.col(c).alias(f"_{c}") for c in columns))
    rows = today.join(prior, "actor", "left")
    fresh = [F.struct(F.lit(c).alias("column"), F.array_sort(F.array_except(F.col(c).cast("array<string>"), F.coalesce(F.col(f"_{c}").cast("array<string>"), F.array().cast("array<string>")))).alias("items")) for c in columns]
    return rows.select("actor", F.explode(F.array(*fresh)).alias("e")).select("actor", "e.column", "e.items").where(F.size("items") > 0)


def hour_grid(before: DataFrame, now: DataFrame) -> DataFrame:
    """(actor, hour, state) for all 24 hours: both, incident, baseline or inactive. Inputs: (actor, hour)."""
    actors = before.select("actor").union(now.select("actor")).distinct()
    grid = actors.withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23))))
    mark = lambda f, n: f.select("actor", "hour").distinct().withColumn(n, F.lit(True))
    out = grid.join(mark(before, "_b"), ["actor", "hour"], "left").join(mark(now, "_n"), ["actor", "hour"], "left")
    b, n = F.col("_b").isNotNull(), F.col("_n").isNotNull()
    return out.select("actor", "hour", F.when(b & n, "both").when(n, "incident").when(b, "baseline").otherwise("inactive").alias("state"))


def volume_comparison(value: Column, mean: Column, std: Column) -> dict[str, Column]:
    """Multiplier and z-score of a day against the baseline, and a class: red from 3 times or 2 deviations, amber from 1.5 times or 1. Null without a baseline."""
    times = X.safe_ratio(value, mean)
    z = F.when(mean > 0, F.coalesce(X.safe_ratio(value - mean, std), F.lit(0.0)))
    level = F.when(times.isNull(), F.lit(None)).when((times >= 3) | (z >= 2), "red").when((times >= 1.5) | (z >= 1), "amber").otherwise("green")
    return {"multiplier": times, "z_score": z, "level": level}


def actor_tag(is_system: Column, is_interface: Column, has_baseline: Column) -> Column:
    return F.when(F.coalesce(is_system, F.lit(False)), "SYSTEM").when(is_interface, "ENI").when(~has_baseline, "NEW").otherwise("HUMAN")


def score_band(score: Column, bounds: tuple[float, float, float] = (0.2, 0.4, 0.7)) -> Column:
    """low, guarded, elevated or high; for scores to 100 the bounds are 20, 40 and 70."""
    return F.when(score >= bounds[2], "high").when(score >= bounds[1], "elevated").when(score >= bounds[0], "guarded").otherwise("low")


def evidence_class(item: Column) -> Column:
    """The class of one flagged item by its label."""
    return (
        F.when(item.startswith("CHAIN") | item.startswith("TRIPLE") | item.startswith("EVENT_PAIR") | item.startswith("BULK_ACCESS") | item.startswith("DEFENSE_EVASION"), "chain")
        .when(item.startswith("RARE"), "rare").when(item.startswith("BURST") | item.startswith("FAST"), "timing").when(item.startswith("DEVIATION"), "deviate").otherwise("sensitive")
    )


def evidence_items(sessions: DataFrame) -> DataFrame:
    """(session_id, item, class) of scored sessions."""
    items = sessions.where("flagged_api_sequences <> 'none'").select("session_id", F.explode(F.split("flagged_api_sequences", r" \| ")).alias("item"))
    return items.withColumn("class", evidence_class(F.col("item")))


DAY_EVIDENCE = "array<struct<date:string,activity_ratio:double,bytes_ratio:double,event_ratio:double,bytes:long,expected_bytes:long,excess_bytes:long,events:long,expected_events:double,distinct_resources:long,rare_resource_events:long,flags:array<string>>>"


def contributing_days(alerts: DataFrame, keep: int = 10, fallback: int = 8) -> DataFrame:
    """Rows of each time alert's first contributing days; of its first days where none contributes."""
    parse = lambda c: F.from_json(c, DAY_EVIDENCE)
    named, every = parse("contributing_day_evidence_json"), parse("daily_evidence_json")
    chosen = F.when(F.size(named) > 0, F.slice(named, 1, keep)).otherwise(F.slice(every, 1, fallback))
    return alerts.where("alert_family = 'time_based'").select("entity_key", F.explode(chosen).alias("d")).select("entity_key", "d.*")


def known_and_new(scores: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Scored actors with a baseline in some source, and those first seen."""
    return scores.where("has_any_baseline"), scores.where(~F.col("has_any_baseline"))


# Evaluation.


def detector_evaluation(scores: DataFrame, truth: DataFrame, score: str = "score") -> DataFrame:
    """(label, n, in_range, tp, fp, fn): truth has actor, label, low, high, expected (whether it should alert) and threshold."""
    rows = truth.join(scores.select("actor", F.col(score).alias("_s")), "actor", "left").withColumn("_s", F.coalesce("_s", F.lit(0.0)))
    alert, expected = F.col("_s") >= F.col("threshold"), F.col("expected")
    return rows.groupBy("label").agg(
        F.count("*").alias("n"), F.count_if(F.col("_s").between(F.col("low"), F.col("high"))).alias("in_range"), F.count_if(alert & expected).alias("tp"),
        F.count_if(alert & ~expected).alias("fp"), F.count_if(~alert & expected).alias("fn"),
    )


def confusion(events: DataFrame, flagged: Column, anomalous: Column, by: list[str]) -> DataFrame:
    """Counts of the four outcomes per group."""
    return events.groupBy(*by).agg(
        F.count_if(flagged & anomalous).alias("tp"), F.count_if(flagged & ~anomalous).alias("fp"), F.count_if(~flagged & anomalous).alias("fn"), F.count_if(~flagged & ~anomalous).alias("tn"),
    )
