"""Baselines from daily partials, so that a new day costs a day.

A partial is what a day knows of an actor, in long form: (day, actor, kind,
value) with counts, sums, sums of squares and first and last times, all of
which merge by addition, minimum or maximum. Hour and day slots never cross a
day, so the statistics over slots merge too; sums are decimals, so means and
deviations do not depend on how days were grouped. A merged baseline equals the
one computed over all events.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilia.functions import exprs as X
from vigilia.operators.baseline import with_actor

SUM = "decimal(38,0)"
KEYS = ["day", "actor", "kind", "value"]
#: n counts events, or slots where kind is a slot statistic, whose sums over slots are total and squares.
PARTIAL = "day date, actor string, kind string, value string, n long, total decimal(38,0), squares decimal(38,0), first_seen timestamp, last_seen timestamp, first_uid long, first_flag boolean"


def _values(rows: DataFrame, kinds: dict[str, Column], blanks: bool = False) -> DataFrame:
    """Counts and times per (day, actor, kind, value); an array column gives a value per element, null values none, nor do empty ones unless `blanks`."""
    types = dict(rows.select(*(c.alias(k) for k, c in kinds.items())).dtypes)
    keep = ["day", "actor", "event_time"]
    single = [k for k in kinds if not types[k].startswith("array")]
    long = rows.select(*keep, *(kinds[k].cast("string").alias(k) for k in single)).unpivot(keep, single, "kind", "value")
    for k in kinds:
        if k not in single:
            long = long.unionByName(rows.select(*keep, F.lit(k).alias("kind"), F.explode(kinds[k].cast("array<string>")).alias("value")))
    long = long.where("value IS NOT NULL" if blanks else "value <> ''")
    return long.groupBy("day", "actor", "kind", "value").agg(F.count("*").alias("n"), F.min("event_time").alias("first_seen"), F.max("event_time").alias("last_seen"))


def _slots(rows: DataFrame, unit: str, kind: str, amount: Column | None = None) -> DataFrame:
    """Number of slots of a day, sum and sum of squares of what they hold: events, or `amount`."""
    held = (F.count(F.lit(1)) if amount is None else F.sum(amount)).cast(SUM)
    per = rows.groupBy("day", "actor", F.date_trunc(unit, "event_time").alias("_slot")).agg(held.alias("_x"))
    out = per.groupBy("day", "actor").agg(F.count("*").alias("n"), F.sum("_x").cast(SUM).alias("total"), F.sum((F.col("_x") * F.col("_x")).cast(SUM)).cast(SUM).alias("squares"))
    return out.select("day", "actor", F.lit(kind).alias("kind"), F.lit("").alias("value"), "n", "total", "squares")


def _days(rows: DataFrame, amount: Column) -> DataFrame:
    """day_slots and day_bytes as `_slots` gives them, and the number of events and their span, from one pass."""
    per = rows.groupBy("day", "actor", F.date_trunc("day", "event_time").alias("_slot")).agg(F.count(F.lit(1)).alias("_x"), F.sum(amount).cast(SUM).alias("_y"), F.min("event_time").alias("_lo"), F.max("event_time").alias("_hi"))
    square = lambda c: F.sum((F.col(c).cast(SUM) * F.col(c).cast(SUM)).cast(SUM)).cast(SUM)
    out = per.groupBy("day", "actor").agg(F.count("*").alias("_n"), F.sum("_x").alias("_events"), square("_x").alias("_xx"), F.sum("_y").cast(SUM).alias("_bytes"), square("_y").alias("_yy"), F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
    no, never = F.lit(None).cast(SUM), F.lit(None).cast("timestamp")
    row = lambda kind, n, total, squares, lo, hi: F.struct(F.lit(kind).alias("kind"), F.lit("").alias("value"), F.col(n).alias("n"), total.alias("total"), squares.alias("squares"), lo.alias("first_seen"), hi.alias("last_seen"))
    each = F.array(row("day_slots", "_n", F.col("_events").cast(SUM), F.col("_xx"), never, never), row("day_bytes", "_n", F.col("_bytes"), F.col("_yy"), never, never), row("events", "_events", no, no, F.col("_lo"), F.col("_hi")))
    return out.select("day", "actor", F.explode(each).alias("p")).select("day", "actor", "p.*")


def _first(rows: DataFrame, flag: Column) -> DataFrame:
    """The number of events, their span, and the flag of the first one."""
    first = F.min(F.struct("event_time", "event_uid", flag.alias("flag")))
    out = rows.groupBy("day", "actor").agg(F.count("*").alias("n"), F.max("event_time").alias("last_seen"), first.alias("_f"))
    return out.select("day", "actor", F.lit("events").alias("kind"), F.lit("").alias("value"), "n", F.col("_f.event_time").alias("first_seen"), "last_seen", F.col("_f.event_uid").cast("long").alias("first_uid"), F.col("_f.flag").alias("first_flag"))


def _table(parts: list[DataFrame]) -> DataFrame:
    """All parts in the columns of PARTIAL."""
    names = [c.rsplit(" ", 1) for c in PARTIAL.split(", ")]
    full = [p.select(*((F.col(n) if n in p.columns else F.lit(None)).cast(t).alias(n) for n, t in names)) for p in parts]
    return reduce(DataFrame.unionByName, full)


def _dated(events: DataFrame, daily: bool) -> DataFrame:
    """Events with their day, or with none where a whole period is one partial."""
    return events.withColumn("day", F.to_date("event_time") if daily else F.lit(None).cast("date"))


def api_partials(events: DataFrame, daily: bool = True) -> DataFrame:
    """Partials of API events: operations, addresses, regions, resources and hours, slots of hours and days, the first event's is_system.

    Events without an operation are counted under the empty one; events without a time have no slot.
    """
    rows = _dated(with_actor(events), daily)
    timed = rows.where("event_time IS NOT NULL")
    missing = rows.where(F.coalesce("operation", F.lit("")) == "").groupBy("day", "actor").agg(F.count("*").alias("n"), F.min("event_time").alias("first_seen"), F.max("event_time").alias("last_seen"))
    missing = missing.withColumns({"kind": F.lit("operation"), "value": F.lit("")})
    kinds = {"operation": F.col("operation"), "ip": F.col("ip"), "region": F.col("region"), "resource": F.col("resources"), "hour": F.hour("event_time")}
    return _table([_values(rows, kinds), missing, _slots(timed, "hour", "hour_slots"), _slots(timed, "day", "day_slots"), _first(rows, F.col("is_system"))])


def access_partials(accesses: DataFrame, daily: bool = True) -> DataFrame:
    rows = _dated(with_actor(accesses), daily)
    kinds = {k: F.col(k) for k in ("operation", "bucket", "ip")}
    return _table([_values(rows, kinds, True), _days(rows, F.coalesce("bytes", F.lit(0)))])


def flow_partials(flows: DataFrame, by: str = "actor", daily: bool = True) -> DataFrame:
    rows = _dated((flows.drop("actor").withColumnRenamed(by, "actor") if by != "actor" else flows).where("actor IS NOT NULL"), daily)
    kinds = {"dst_ip": F.col("dst_ip"), "dst_port": F.col("dst_port"), "dst_conn": F.concat_ws(":", "dst_ip", F.col("dst_port").cast("string")), "protocol": F.col("protocol")}
    return _table([_values(rows, kinds, True), _days(rows, F.coalesce("bytes", F.lit(0)))])


def merged(partials: DataFrame) -> DataFrame:
    """(actor, kind, value) over all the days given: counts and sums added, the earliest first event's flag, which rows of kind `events` alone have."""
    keys = ["actor", "kind", "value"]
    sums = [
        F.sum("n").alias("n"), F.sum("total").cast(SUM).alias("total"), F.sum("squares").cast(SUM).alias("squares"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
    ]
    first = F.min(F.struct("first_seen", "first_uid", "first_flag"))  # a minimum of structs is found by sorting, so only what has a flag goes through it
    flagged = partials.where("kind = 'events'").groupBy(*keys).agg(*sums, first.alias("_f")).withColumn("first_flag", F.col("_f.first_flag")).drop("_f")
    return partials.where("kind <> 'events'").groupBy(*keys).agg(*sums).withColumn("first_flag", F.lit(None).cast("boolean")).unionByName(flagged)


def _mean() -> Column:
    return X.settled(F.col("total").cast("double") / F.col("n"))


def _deviation() -> Column:
    """Sample deviation from exact sums, 0 for one slot."""
    n = F.col("n").cast(SUM)
    spread = (n * F.col("squares")).cast(SUM) - (F.col("total") * F.col("total")).cast(SUM)
    return X.settled(F.when(F.col("n") > 1, F.sqrt(spread.cast("double") / (F.col("n") * (F.col("n") - 1)))).otherwise(F.lit(0.0)))


def merged_stats(whole: DataFrame, kind: str) -> DataFrame:
    """(actor, mean, std, slots) of one slot statistic."""
    return whole.where(F.col("kind") == kind).select("actor", _mean().alias("mean"), _deviation().alias("std"), F.col("n").alias("slots"))


def merged_baseline(partials: DataFrame, sets: dict[str, str], histograms: dict[str, str], stats: dict[str, str]) -> DataFrame:
    """One row per actor: `event_count`, `is_system`, and the sets, histograms and statistics named (kind: column), from one pass over the partials."""
    whole = merged(partials)
    is_kind = lambda k: F.col("kind") == k
    named = [F.array_sort(F.collect_list(F.when(is_kind(k), F.col("value")))).alias(c) for k, c in sets.items()]
    named += [F.map_from_entries(F.array_sort(F.collect_list(F.when(is_kind(k), F.struct("value", "n"))))).alias(c) for k, c in histograms.items()]
    named += [F.max(F.when(is_kind(k), F.struct(_mean().alias("mean"), _deviation().alias("std"), F.col("n").alias("slots")))).alias(c) for k, c in stats.items()]
    return whole.groupBy("actor").agg(F.max(F.when(is_kind("events"), F.col("n"))).alias("event_count"), F.max(F.when(is_kind("events"), F.col("first_flag"))).alias("is_system"), *named)


def api_baseline_of(partials: DataFrame) -> DataFrame:
    return merged_baseline(partials, {"ip": "known_ips", "region": "known_regions", "resource": "known_resources"}, {"operation": "known_operations", "hour": "known_hours"}, {"hour_slots": "volume_stats", "day_slots": "daily_events"})


def access_baseline_of(partials: DataFrame) -> DataFrame:
    return merged_baseline(partials, {"operation": "known_operations", "bucket": "known_buckets", "ip": "known_ips"}, {}, {"day_slots": "daily_events", "day_bytes": "daily_bytes"}).drop("is_system")


def flow_baseline_of(partials: DataFrame) -> DataFrame:
    return merged_baseline(partials, {"dst_ip": "known_dst_ips", "dst_port": "known_dst_ports", "dst_conn": "known_dst_conns", "protocol": "known_protocols"}, {}, {"day_slots": "daily_flows", "day_bytes": "daily_bytes"}).drop("is_system")


# What scoring reads of a clean period: the rows of `merged` without times and flags, each already one per key, so that nothing is merged.


def _period(parts: list[DataFrame]) -> DataFrame:
    names = {"actor": "string", "kind": "string", "value": "string", "n": "long", "total": SUM, "squares": SUM}
    full = [p.select(*((F.col(n) if n in p.columns else F.lit(None)).cast(t).alias(n) for n, t in names.items())) for p in parts]
    return reduce(DataFrame.unionByName, full)


def api_period(events: DataFrame) -> DataFrame:
    rows = _dated(with_actor(events), False)
    timed = rows.where("event_time IS NOT NULL")
    kinds = {"operation": F.coalesce("operation", F.lit("")), "ip": F.nullif("ip", F.lit("")), "region": F.nullif("region", F.lit("")), "resource": F.col("resources"), "hour": F.hour("event_time")}
    counts = rows.groupBy("actor").agg(F.count("*").alias("n")).select("actor", F.lit("events").alias("kind"), F.lit("").alias("value"), "n")
    return _period([_values(rows, kinds, True).where("kind <> 'resource' OR value <> ''"), _slots(timed, "hour", "hour_slots"), counts])


def access_period(accesses: DataFrame) -> DataFrame:
    rows = _dated(with_actor(accesses), False)
    return _period([_values(rows, {k: F.col(k) for k in ("operation", "bucket", "ip")}, True), _days(rows, F.coalesce("bytes", F.lit(0)))])


def flow_period(flows: DataFrame) -> DataFrame:
    rows = _dated(flows.where("actor IS NOT NULL"), False)
    return _period([_values(rows, {k: F.col(k) for k in ("dst_ip", "dst_port", "protocol")}, True), _days(rows, F.coalesce("bytes", F.lit(0)))])
