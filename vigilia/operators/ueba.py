"""Behaviour scores of actors: six deviations per source, combined by their maximum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from vigilia.functions import exprs as X
from vigilia.functions import fixed
from vigilia.operators.baseline import long_values, with_actor
from vigilia.operators.incremental import access_period, api_period, flow_period, merged_stats
from vigilia.sources.stored import stored

ACCESS_DIMS = ("new_operation", "new_bucket", "new_src_ip", "error_rate", "bytes_zscore", "event_zscore")
NO_TIME = "0001-01-01 00:00:00"  # the slot of events without a time
HOT_PARTS = 256  # a combination with more than this part of all events is dealt over several tasks
FLOW_DIMS = ("new_dst_ip", "new_dst_port", "reject_ratio", "bytes_zscore", "flow_zscore", "new_protocol")


COMBINATION = ["actor", "_slot_key", "operation", "region", "ip", "resources"]


def _combined(events: DataFrame) -> DataFrame:
    """Events with the keys of their combination, none of which is null."""
    none = F.array().cast("array<string>")
    return with_actor(events).withColumns({
        **{c: F.coalesce(c, F.lit("")) for c in ("operation", "region", "ip")}, "resources": F.coalesce("resources", none), "_slot_key": F.coalesce(F.date_trunc("hour", "event_time"), F.lit(NO_TIME).cast("timestamp")),
    })


def api_combinations(events: DataFrame, baseline: DataFrame, also: dict[str, Column] | None = None) -> DataFrame:
    """The six deviations of each combination of actor, hour slot, operation, region, address and resources, with its number of events.

    Novelty is an equi join with the baseline's distinct (actor, kind, value)
    rows, so no actor's set of known values is ever one row, and what joins are
    combinations, not events. A missing operation counts as new. `also` names
    further aggregates of a combination's events.
    """
    whole = stored(api_period(baseline))  # one pass over the baseline; all that follows reads these rows
    seen = whole.where(F.col("kind").isin("operation", "region", "ip", "resource")).select("actor", "kind", "value")  # with the empty operation, if the baseline has it
    hours = whole.where(F.col("kind") == "hour").select("actor", F.col("value").cast("int").alias("hour"), "n")
    peak = hours.groupBy("actor").agg(F.max("n").alias("_peak"))
    volume = merged_stats(whole, "hour_slots").select("actor", F.col("mean").alias("_mean"), F.col("std").alias("_std"))
    actors = whole.where(F.col("kind") == "events").select("actor").join(volume, "actor", "left").join(peak, "actor", "left")
    out = _combined(events).groupBy(*COMBINATION).agg(F.count("*").alias("_events"), *(c.alias(n) for n, c in (also or {}).items())).join(actors, "actor")
    timed = F.col("_slot_key") != F.lit(NO_TIME).cast("timestamp")
    out = out.withColumns({"hour": F.when(timed, F.hour("_slot_key")), "_slot": F.when(timed, F.sum("_events").over(W.partitionBy("actor", "_slot_key")))})
    for kind in ("operation", "region", "ip"):
        side = seen.where(F.col("kind") == kind).select("actor", F.col("value").alias(kind), F.lit(True).alias(f"_{kind}"))
        out = out.join(side, ["actor", kind], "left")
    named = _combined(events).select("actor", "resources").distinct().select("actor", "resources", F.explode("resources").alias("value")).where("value IS NOT NULL")
    novel = named.join(seen.where("kind = 'resource'").select("actor", "value"), ["actor", "value"], "left_anti").select("actor", "resources").distinct()
    out = out.join(novel.withColumn("_resource", F.lit(True)), ["actor", "resources"], "left").join(hours.withColumnRenamed("n", "_n"), ["actor", "hour"], "left")
    flag = lambda c: F.when(c, F.lit(1.0)).otherwise(F.lit(0.0))
    return out.withColumns({
        "d_op": flag(F.col("_operation").isNull()), "d_resource": flag(F.col("_resource").isNotNull()), "d_region": flag((F.col("region") != "") & F.col("_region").isNull()),
        "d_volume": F.when(F.col("_slot").isNull(), F.lit(0.0)).otherwise(X.deviation(F.col("_slot").cast("double"), F.coalesce("_mean", F.lit(0.0)), F.coalesce("_std", F.lit(0.0)))),
        "d_ip": flag((F.col("ip") != "") & F.col("_ip").isNull() & (F.col("region") != "") & F.col("_region").isNotNull()),
        "d_hour": F.when(F.col("hour").isNull() | F.col("_peak").isNull(), F.lit(0.0)).otherwise(1 - F.coalesce(F.col("_n"), F.lit(0)) / F.col("_peak")),
    }).withColumn("composite", X.weighted(fixed.CT_WEIGHTS)).select(*COMBINATION, "_events", *(also or {}), *fixed.CT_WEIGHTS, "composite")


def api_event_dimensions(events: DataFrame, baseline: DataFrame, parts: int = HOT_PARTS) -> DataFrame:
    """The six deviations of each event from its actor's baseline events, and their weighted sum. Events of actors without a baseline are left out.

    Each event takes those of its combination in one join. A combination with
    more than 1 in `parts` of all events, of which there are fewer than `parts`,
    is copied so often that each copy meets about that share of them.
    """
    found = stored(api_combinations(events, baseline))
    copies = lambda: F.ceil(F.col("_events") * parts / F.col("_all")).cast("int")
    spread = found.crossJoin(F.broadcast(found.agg(F.sum("_events").alias("_all")))).withColumn("_copies", F.greatest(copies(), F.lit(1)))
    hot = spread.where("_copies > 1").select(*COMBINATION, "_copies")  # fewer than `parts`
    rows = _combined(events).select(*COMBINATION, "event_uid", "event_time").join(F.broadcast(hot), COMBINATION, "left")
    rows = rows.withColumn("_copy", F.pmod(F.xxhash64("event_uid", "event_time"), F.coalesce("_copies", F.lit(1))).cast("int")).drop("_copies")
    sides = spread.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)))
    return rows.join(sides, [*COMBINATION, "_copy"]).select("actor", "event_uid", "event_time", *fixed.CT_WEIGHTS, "composite")


def api_scores(dimensions: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(actor, score, score_max, event_count, means of the dimensions), four decimals."""
    return dimensions.groupBy(*(by or ["actor"])).agg(
        X.settled(F.avg("composite")).alias("score"), X.settled(F.max("composite")).alias("score_max"), F.count("*").alias("event_count"),
        *(X.settled(F.avg(d)).alias(d) for d in fixed.CT_WEIGHTS),
    )


def api_daily_scores(events: DataFrame, baseline: DataFrame) -> DataFrame:
    """`api_scores` per actor and day of the events, from combinations: all events of one have its deviations and its day, so no event meets them."""
    rows = api_combinations(events, baseline)
    n, timed = F.sum("_events"), F.col("_slot_key") != F.lit(NO_TIME).cast("timestamp")
    mean = lambda c: X.settled(F.sum(F.col(c) * F.col("_events")) / n)
    return rows.groupBy("actor", F.when(timed, F.to_date("_slot_key")).alias("day")).agg(mean("composite").alias("score"), X.settled(F.max("composite")).alias("score_max"), n.alias("event_count"), *(mean(d).alias(d) for d in fixed.CT_WEIGHTS))


def novel_kinds(today: DataFrame, before: DataFrame, by: list[str]) -> DataFrame:
    """(by, novel): the kinds of which today's rows (by, kind, value) have a value that the actor's baseline rows (actor, kind, value) lack.

    Values meet in an anti-join, so no actor's set of values is ever one row.
    """
    fresh = today.where(F.col("value").isNotNull()).select(*by, "kind", "value").distinct().join(before.select("actor", "kind", "value").distinct(), ["actor", "kind", "value"], "left_anti")
    return fresh.groupBy(*by).agg(F.collect_set("kind").alias("novel"))  # as many as there are kinds


def _known(whole: DataFrame, stats: dict[str, str]) -> DataFrame:
    """(actor, _known and the statistics named) of the actors that a merged baseline has."""
    rows = whole.where(F.col("kind") == "events").select("actor", F.lit(True).alias("_known"))
    for kind, name in stats.items():
        rows = rows.join(merged_stats(whole, kind).select("actor", F.struct("mean", "std").alias(name)), "actor", "left")
    return rows


def _has(kind: str) -> Column:
    return F.when(F.array_contains(F.coalesce("novel", F.array().cast("array<string>")), kind), F.lit(1.0)).otherwise(F.lit(0.0))


def _scored(rows: DataFrame, dims: dict[str, Column], by: list[str]) -> DataFrame:
    out = rows.withColumns(dims)
    return out.select(
        *by, X.settled(X.mean_of(list(dims))).alias("score"), "event_count", F.col("_known").isNotNull().alias("has_baseline"), *(X.settled(F.col(d)).alias(d) for d in dims)
    )


def _counted(rows: DataFrame, by: list[str], bad: Column, name: str) -> DataFrame:
    """(by, event_count, bytes_total and how many are bad): what scores need of a profile."""
    return rows.groupBy(*by).agg(F.count("*").alias("event_count"), F.sum(F.coalesce("bytes", F.lit(0))).alias("bytes_total"), F.count_if(bad).alias(name))


def access_scores(accesses: DataFrame, baseline: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Object accesses against those of the clean period: without a baseline everything is new and only bytes, on a log scale, and errors tell actors apart."""
    by, kinds = by or ["actor"], {k: k for k in ("operation", "bucket", "ip")}
    rows, before = with_actor(accesses), stored(access_period(baseline))
    known = _known(before, {"day_slots": "_daily_events", "day_bytes": "_daily_bytes"})
    novel = novel_kinds(long_values(rows, kinds, by), before, by)
    out = _counted(rows, by, F.col("code").isNotNull() & ~F.col("code").cast("string").startswith("2"), "error_count").join(known, "actor", "left").join(novel, by, "left")
    either = lambda a, b: F.when(F.col("_known").isNotNull(), a).otherwise(b)
    one = F.lit(1.0)
    dims = dict(zip(ACCESS_DIMS, (
        either(_has("operation"), one), either(_has("bucket"), one), either(_has("ip"), one),
        F.coalesce(F.try_divide("error_count", "event_count"), F.lit(0.0)),
        either(X.deviation(F.col("bytes_total").cast("double"), F.col("_daily_bytes.mean"), F.col("_daily_bytes.std")), X.bytes_score(F.col("bytes_total"))),
        either(X.deviation(F.col("event_count").cast("double"), F.col("_daily_events.mean"), F.col("_daily_events.std")), one),
    )))
    return _scored(out, dims, by)


def flow_scores(flows: DataFrame, baseline: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Flows against those of the clean period; a port is new only if it was seen more than once."""
    by, kinds = by or ["actor"], {k: k for k in ("dst_ip", "dst_port", "protocol")}
    rows, before = flows.where(F.col("actor").isNotNull()), stored(flow_period(baseline))
    known = _known(before, {"day_slots": "_daily_flows", "day_bytes": "_daily_bytes"})
    today = long_values(rows, kinds, by).groupBy(*by, "kind", "value").agg(F.count("*").alias("_n")).where((F.col("kind") != "dst_port") | (F.col("_n") > 1))
    novel = novel_kinds(today, before, by)
    out = _counted(rows, by, F.col("action") == "REJECT", "reject_count").join(known, "actor", "left").join(novel, by, "left")
    either = lambda a, b: F.when(F.col("_known").isNotNull(), a).otherwise(b)
    one = F.lit(1.0)
    dims = dict(zip(FLOW_DIMS, (
        either(_has("dst_ip"), one), either(_has("dst_port"), one), F.coalesce(F.try_divide("reject_count", "event_count"), F.lit(0.0)),
        either(X.deviation(F.col("bytes_total").cast("double"), F.col("_daily_bytes.mean"), F.col("_daily_bytes.std")), X.bytes_score(F.col("bytes_total"))),
        either(X.deviation(F.col("event_count").cast("double"), F.col("_daily_flows.mean"), F.col("_daily_flows.std")), one),
        either(_has("protocol"), one),
    )))
    return _scored(out, dims, by)


def combine_scores(api: DataFrame, access: DataFrame, flow: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(actor, final_score, sources_used, the three scores, has_any_baseline) of every actor with a score from any source."""
    by = by or ["actor"]
    a = api.select(*by, F.col("score").alias("api_score"))
    b = access.select(*by, F.col("score").alias("access_score"), F.col("has_baseline").alias("_b"))
    c = flow.select(*by, F.col("score").alias("flow_score"), F.col("has_baseline").alias("_c"))
    out = a.join(b, by, "full_outer").join(c, by, "full_outer")
    names = {"api_score": "cloudtrail", "access_score": "s3", "flow_score": "vpc"}
    return out.select(
        *by, F.greatest(*names).alias("final_score"), X.compact(*(F.when(F.col(k).isNotNull(), F.lit(v)) for k, v in names.items())).alias("sources_used"), *names,
        (F.col("api_score").isNotNull() | F.coalesce("_b", F.lit(False)) | F.coalesce("_c", F.lit(False))).alias("has_any_baseline"),
    )
