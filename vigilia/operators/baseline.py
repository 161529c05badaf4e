"""Baselines of a clean period and profiles of single days, per actor.

API events: actor, event_time, event_uid, operation, region, ip, resources
(array), is_system. Object accesses: actor, event_time, operation, bucket, ip,
bytes, code. Flows: eni, src_ip, dst_ip, dst_port, protocol, bytes, action,
event_time. Sets are sorted arrays, histograms maps; days without events take
no part in means.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilia.functions import exprs as X

known = lambda c: F.array_sort(F.collect_set(c))


def with_actor(events: DataFrame) -> DataFrame:
    return events.where(F.col("actor").isNotNull() & (F.col("actor") != ""))


def long_values(rows: DataFrame, kinds: dict[str, str], keep: list[str] | None = None) -> DataFrame:
    """(keep, kind, value) rows of the columns that `kinds` names, as text; `keep` is the actor unless given."""
    keep = keep or ["actor"]
    named = rows.select(*keep, *(F.col(c).cast("string").alias(f"_k_{k}") for k, c in kinds.items()))
    long = named.unpivot(keep, [f"_k_{k}" for k in kinds], "kind", "value")
    return long.select(*keep, F.substring("kind", 4, 1000).alias("kind"), "value")


def slot_stats(events: DataFrame, unit: str, value: Column | None = None, by: str = "actor") -> DataFrame:
    """(by, mean, std, slots) of the events, or of the summed value, per hour or day; sample deviation, 0 for one slot; four decimals."""
    amount = F.count(F.lit(1)) if value is None else F.sum(value)
    per = events.groupBy(by, F.date_trunc(unit, "event_time").alias("_slot")).agg(amount.cast("double").alias("_x"))
    return per.groupBy(by).agg(X.settled(F.avg("_x")).alias("mean"), X.settled(F.coalesce(F.stddev_samp("_x"), F.lit(0.0))).alias("std"), F.count("*").alias("slots"))


def hour_counts(events: DataFrame) -> DataFrame:
    return with_actor(events).where("event_time IS NOT NULL").groupBy("actor", F.hour("event_time").alias("hour")).agg(F.count("*").alias("n"))


def operation_counts(events: DataFrame) -> DataFrame:
    return with_actor(events).groupBy("actor", F.coalesce("operation", F.lit("")).alias("operation")).agg(F.count("*").alias("n"))


def known_values(events: DataFrame) -> DataFrame:
    """Long form (actor, kind, value, n, first_seen, last_seen) of operations, ips, regions and resources."""
    pairs = F.array(
        *(F.struct(F.lit(kind).alias("kind"), F.col(c).alias("value")) for kind, c in (("operation", "operation"), ("ip", "ip"), ("region", "region"))),
    )
    resources = F.transform(F.coalesce("resources", F.array().cast("array<string>")), lambda r: F.struct(F.lit("resource").alias("kind"), r.alias("value")))
    rows = with_actor(events).select("actor", "event_time", F.explode(F.concat(pairs, resources)).alias("p")).where("p.value IS NOT NULL AND p.value <> ''")
    return rows.groupBy("actor", F.col("p.kind").alias("kind"), F.col("p.value").alias("value")).agg(F.count("*").alias("n"), F.min("event_time").alias("first_seen"), F.max("event_time").alias("last_seen"))


def api_baseline(events: DataFrame) -> DataFrame:
    """One row per actor: known sets, operation and hour histograms, slot and day statistics, is_system of its first event, event count."""
    rows = with_actor(events)
    sets = known_values(rows).groupBy("actor").agg(*(F.array_sort(F.collect_set(F.when(F.col("kind") == k, F.col("value")))).alias(f"known_{k}s") for k in ("ip", "region", "resource")))
    ops = operation_counts(rows).groupBy("actor").agg(X.histogram("operation", "n").alias("known_operations"))
    hours = hour_counts(rows).groupBy("actor").agg(X.histogram("hour", "n").alias("known_hours"))
    base = rows.groupBy("actor").agg(F.min_by("is_system", F.struct("event_time", "event_uid")).alias("is_system"), F.count("*").alias("event_count"))
    stats = slot_stats(rows, "hour").select("actor", F.struct("mean", "std", "slots").alias("volume_stats"))
    days = slot_stats(rows, "day").select("actor", F.struct("mean", "std").alias("daily_events"))
    out = base
    for part in (sets, ops, hours, stats, days):
        out = out.join(part, "actor", "left")
    return out


def access_baseline(accesses: DataFrame) -> DataFrame:
    rows = with_actor(accesses)
    base = rows.groupBy("actor").agg(known("operation").alias("known_operations"), known("bucket").alias("known_buckets"), known("ip").alias("known_ips"), F.count("*").alias("event_count"))
    events = slot_stats(rows, "day").select("actor", F.struct("mean", "std").alias("daily_events"))
    volume = slot_stats(rows, "day", F.coalesce("bytes", F.lit(0))).select("actor", F.struct("mean", "std").alias("daily_bytes"))
    return base.join(events, "actor").join(volume, "actor")


def flow_baseline(flows: DataFrame, by: str = "actor") -> DataFrame:
    rows = flows.where(F.col(by).isNotNull())
    conn = F.concat_ws(":", "dst_ip", F.col("dst_port").cast("string"))
    base = rows.groupBy(by).agg(known("dst_ip").alias("known_dst_ips"), known("dst_port").alias("known_dst_ports"), known(conn).alias("known_dst_conns"), known("protocol").alias("known_protocols"), F.count("*").alias("event_count"))
    flow = slot_stats(rows, "day", by=by).select(by, F.struct("mean", "std").alias("daily_flows"))
    volume = slot_stats(rows, "day", F.coalesce("bytes", F.lit(0)), by).select(by, F.struct("mean", "std").alias("daily_bytes"))
    return base.join(flow, by).join(volume, by)


# Who is behind a flow: the last actor seen at an address, or at an interface through its addresses.


def last_actor_by_ip(events: DataFrame) -> DataFrame:
    rows = with_actor(events).where("ip IS NOT NULL AND ip <> ''")
    return rows.groupBy(F.col("ip").alias("src_ip")).agg(F.max_by("actor", F.struct("event_time", "event_uid")).alias("actor"))


def resolve_flows(flows: DataFrame, ip_actors: DataFrame) -> DataFrame:
    """Add `actor`: by source ip, else by interface (the actor of its latest resolved flow), else the interface itself."""
    rows = flows.join(ip_actors, "src_ip", "left")
    eni = rows.where("actor IS NOT NULL AND eni IS NOT NULL").groupBy("eni").agg(F.max_by("actor", F.struct("event_time", "src_ip")).alias("_eni_actor"))
    return rows.join(eni, "eni", "left").withColumn("actor", F.coalesce("actor", "_eni_actor", "eni")).drop("_eni_actor")


def resolve_interfaces(flows: DataFrame, ip_actors: DataFrame) -> DataFrame:
    """(eni, actor, resolved_ip): the smallest source ip of an interface that has an actor; null if none has."""
    seen = flows.where("eni IS NOT NULL").select("eni", "src_ip").distinct().join(ip_actors, "src_ip", "left")
    first = F.min(F.when(F.col("actor").isNotNull(), F.struct("src_ip", "actor")))
    return seen.groupBy("eni").agg(first.alias("_f")).select("eni", F.col("_f.actor").alias("actor"), F.col("_f.src_ip").alias("resolved_ip"))


# Profiles of a day (or of any period).


def seen_between(events: DataFrame, by: list[str], key: str) -> DataFrame:
    """(by, entries): (key, first_seen, last_seen) of every value, sorted by it."""
    per = events.where(F.col(key).isNotNull()).groupBy(*by, key).agg(F.min("event_time").alias("first_seen"), F.max("event_time").alias("last_seen"))
    return per.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(key, "first_seen", "last_seen"))).alias(f"{key}s"))


def ordered_counts(events: DataFrame, by: list[str], key: str, name: str) -> DataFrame:
    """(by, name): (key, n) of every value, the most frequent first, of equal ones the lesser value."""
    per = events.where(F.col(key).isNotNull()).groupBy(*by, key).agg(F.count("*").alias("n"))
    sorted_up = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("_"), F.col(key).alias(key), "n")))
    return per.groupBy(*by).agg(F.transform(sorted_up, lambda x: F.struct(x[key].alias(key), x["n"].alias("n"))).alias(name))


def distinct_values(events: DataFrame, by: list[str], key: str, name: str) -> DataFrame:
    """(by, name): the distinct values in order; they are told apart as rows, so repeats never meet in one group."""
    return events.where(F.col(key).isNotNull()).select(*by, key).distinct().groupBy(*by).agg(F.array_sort(F.collect_list(key)).alias(name))


def _all(out: DataFrame, parts: list[DataFrame], by: list[str]) -> DataFrame:
    for part in parts:
        out = out.join(part, by, "left")
    return out


def api_profile(events: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts, known sets, (value, first_seen, last_seen) of addresses and, where the events have them, of uid_alt and type, and hours by count.

    is_system is that of the first event, uid the first that is not null.
    """
    by = by or ["actor"]
    rows = with_actor(events)
    when = F.struct("event_time", "event_uid")
    more = [F.min_by("uid", F.when(F.col("uid").isNotNull(), when)).alias("uid")] if "uid" in rows.columns else []
    out = rows.groupBy(*by).agg(
        F.count("*").alias("event_count"), F.min_by("is_system", when).alias("is_system"), *more, F.min("event_time").alias("first_seen"), F.max("event_time").alias("last_seen"),
        known("operation").alias("known_operations"), known("region").alias("known_regions"),
    )
    named = rows.select(*by, F.explode("resources").alias("_resource"))
    hours = ordered_counts(rows.where("event_time IS NOT NULL").withColumn("hour", F.hour("event_time")), by, "hour", "hours")
    spans = [seen_between(rows, by, c) for c in ("ip", "uid_alt", "type") if c in rows.columns]
    out = _all(out, [distinct_values(named, by, "_resource", "known_resources"), *spans, hours], by)
    return out.withColumn("known_resources", F.coalesce("known_resources", F.array().cast("array<string>")))


def access_profile(accesses: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts, sets, codes by count, spans of addresses and the largest request; its time is that of the earliest such request, null where no byte was sent."""
    by = by or ["actor"]
    rows = with_actor(accesses).withColumn("_b", F.coalesce("bytes", F.lit(0)))
    out = rows.groupBy(*by).agg(
        F.count("*").alias("event_count"), F.sum("_b").alias("bytes_total"), F.max("_b").alias("bytes_max"), F.max_by("event_time", F.struct("_b", -X.epoch_us("event_time"))).alias("_t"),
        F.count_if(F.col("code").isNotNull() & ~F.col("code").cast("string").startswith("2")).alias("error_count"),
        known("operation").alias("known_operations"), known("bucket").alias("known_buckets"), known("ip").alias("known_ips"),
    )
    out = out.withColumn("bytes_max_time", F.when(F.col("bytes_max") > 0, F.col("_t"))).drop("_t")
    return _all(out, [ordered_counts(rows, by, "code", "response_codes"), seen_between(rows, by, "ip")], by)


def flow_profile(flows: DataFrame, by: list[str]) -> DataFrame:
    """Profile per interface or per resolved actor; of an actor's ports only those seen more than once count for novelty (`dst_ports`).

    Histograms of ports, connections (address:port) and actions have the most
    frequent first; `dst_spans` has each destination's first and last time.
    """
    rows = flows.withColumns({"_b": F.coalesce("bytes", F.lit(0)), "connection": F.concat_ws(":", "dst_ip", F.col("dst_port").cast("string"))})
    rows = rows.withColumn("connection", F.when(F.col("dst_ip").isNotNull() & F.col("dst_port").isNotNull(), F.col("connection")))
    out = rows.groupBy(*by).agg(
        F.count("*").alias("event_count"), F.sum("_b").alias("bytes_total"), F.max("_b").alias("bytes_max"), F.max_by("event_time", F.struct("_b", -X.epoch_us("event_time"))).alias("_t"),
        F.count_if(F.col("action") == "REJECT").alias("reject_count"), F.min("event_time").alias("first_seen"), F.max("event_time").alias("last_seen"),
        known("dst_ip").alias("dst_ips"), known("protocol").alias("protocols"), known("src_ip").alias("src_ips"),
    )
    out = out.withColumn("bytes_max_time", F.when(F.col("bytes_max") > 0, F.col("_t"))).drop("_t")
    counts = [ordered_counts(rows, by, c, n) for c, n in (("dst_port", "port_counts"), ("connection", "connections"), ("action", "actions"))]
    out = _all(out, [*counts, seen_between(rows, by, "dst_ip").withColumnRenamed("dst_ips", "dst_spans")], by)
    return out.withColumn("dst_ports", F.array_sort(F.transform(F.filter(F.coalesce("port_counts", F.array()), lambda x: x["n"] > 1), lambda x: x["dst_port"])))


def assemble_profiles(api: DataFrame, access: DataFrame, flow: DataFrame) -> DataFrame:
    """One row per actor of any source, absent sides null. is_system is null for actors without API events and false for interfaces alone."""
    pack = lambda df, name: df.select("actor", F.struct(*(c for c in df.columns if c != "actor")).alias(name))
    out = pack(api, "api").join(pack(access, "access"), "actor", "full_outer").join(pack(flow, "flow"), "actor", "full_outer")
    alone = F.col("api").isNull() & F.col("access").isNull()
    return out.withColumn("is_system", F.when(alone, F.lit(False)).otherwise(F.col("api.is_system")))


def profile_counts(profiles: DataFrame, interfaces: DataFrame) -> DataFrame:
    """Human and system actors, resolved and unresolved interfaces."""
    actors = profiles.agg(F.count_if(F.coalesce(~F.col("is_system"), F.lit(True))).alias("human_actors"), F.count_if(F.col("is_system")).alias("system_actors"))
    nets = interfaces.agg(F.count_if(F.col("actor").isNotNull()).alias("resolved_interfaces"), F.count_if(F.col("actor").isNull()).alias("unresolved_interfaces"))
    return actors.crossJoin(nets)


def flow_counts(flows: DataFrame, ip_actors: DataFrame) -> DataFrame:
    """One row: total flows, those with an actor by their address, by their interface, with the interface alone, and skipped ones, which have none of these."""
    known = F.col("actor").isNotNull() & (F.col("actor") != F.coalesce("eni", F.lit("")))
    own = resolve_flows(flows.join(ip_actors.select("src_ip", F.lit(True).alias("_own")), "src_ip", "left"), ip_actors)
    by_ip = F.coalesce(F.col("_own"), F.lit(False))
    return own.agg(
        F.count("*").alias("total_flows"), F.count_if(by_ip).alias("by_address"), F.count_if(~by_ip & known).alias("by_interface"),
        F.count_if(~by_ip & F.col("actor").isNotNull() & ~known).alias("interface_alone"), F.count_if(F.col("actor").isNull()).alias("skipped_flows"),
    )


def actor_slices(profiles: DataFrame, interfaces: DataFrame) -> DataFrame:
    """(slice, actor): the human and the system actors, and the interfaces behind which no actor is known."""
    named = profiles.select(F.when(F.coalesce("is_system", F.lit(False)), "system").otherwise("human").alias("slice"), "actor")
    return named.unionByName(interfaces.where("actor IS NULL").select(F.lit("unresolved_interface").alias("slice"), F.col("eni").alias("actor")))
