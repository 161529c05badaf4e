"""Sessions by gaps, their features, the global model of them and the kill-chain score.

Events: identity_id, event_time, event_uid (breaks ties), event_name,
event_source, source_ip, aws_region, action_category, is_sensitive, is_failed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from vigilia.functions import exprs as X
from vigilia.functions import fixed
from vigilia.operators.quantiles import grouped_quantiles
from vigilia.sources.stored import stored

BUCKET_DAYS = 1
STRETCH_MINUTES = 30  # of a session that are ordered together; no less than the window of a burst
SHORT_EVENTS = 100  # a session of no more events is one row's work
PIECE_EVENTS = 1000  # events in a row of `session_sequences`
TIED_EVENTS = 64  # events by which sequences of equal counts are compared first
CALLS = 6  # first calls of a category that texts may name
MARKED_EVENTS = sorted({e for pair in fixed.EVENT_PAIRS for e in pair})


def sessionize(events: DataFrame, gap_minutes: float = fixed.GAP_MINUTES, bucket_days: int | None = BUCKET_DAYS) -> DataFrame:
    """Add session_number (from 1 per identity) and session_id. A new session starts after a gap of strictly more than `gap_minutes`.

    The events of an identity are ordered per stretch of `bucket_days` days, and
    only one row per stretch meets the others, so that an identity with most of
    all events is no longer one task's work. None orders them all at once.
    """
    gap, t = int(gap_minutes * 60_000_000), X.epoch_us("event_time")
    named = lambda n: F.concat("identity_id", F.lit("_s"), n.cast("string"))
    if bucket_days is None:
        order = W.partitionBy("identity_id").orderBy("event_time", "event_uid")
        new = F.coalesce((t - F.lag(t).over(order) > gap).cast("int"), F.lit(1))
        out = events.withColumn("_new", new).withColumn("session_number", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)))
        return out.drop("_new").withColumn("session_id", named(F.col("session_number")))
    rows = events.withColumn("_t", t).withColumn("_stretch", F.floor(F.col("_t") / (bucket_days * 86_400_000_000)))
    inner = W.partitionBy("identity_id", "_stretch").orderBy("event_time", "event_uid")
    rows = rows.withColumn("_new", F.coalesce((F.col("_t") - F.lag("_t").over(inner) > gap).cast("int"), F.lit(0)))
    rows = rows.withColumn("_inside", F.sum("_new").over(inner.rowsBetween(W.unboundedPreceding, 0)))
    ends = rows.groupBy("identity_id", "_stretch").agg(F.min("_t").alias("lo"), F.max("_t").alias("hi"), F.sum("_new").alias("n"))
    outer = W.partitionBy("identity_id").orderBy("_stretch")
    ends = ends.withColumn("opens", F.coalesce((F.col("lo") - F.lag("hi").over(outer) > gap).cast("int"), F.lit(1)))
    ends = ends.withColumn("_base", F.sum(F.col("opens") + F.col("n")).over(outer.rowsBetween(W.unboundedPreceding, 0)) - F.col("n"))
    out = rows.join(ends.select("identity_id", "_stretch", "_base"), ["identity_id", "_stretch"])
    out = out.withColumn("session_number", F.col("_base") + F.col("_inside")).drop("_t", "_stretch", "_new", "_inside", "_base")
    return out.withColumn("session_id", named(F.col("session_number"))).select(*events.columns, "session_number", "session_id")


def placed_events(events: DataFrame, stretch_minutes: int = STRETCH_MINUTES, burst_seconds: int = fixed.BURST_SECONDS) -> DataFrame:
    """`sessionize`d events with _place (from 1 in the session), _burst, _listed, and the next ones' _c2, _c3 and _e2.

    Events are ordered per stretch of time of a session, so a session that never
    ends is many tasks' work. A stretch begins with copies of the last
    `burst_seconds` before it, for _burst: the events in the window that ends
    with an event, both ends counted. What else lies beyond its borders comes
    from one row per stretch: how many events came before, whether ListBuckets
    was among them, and the two events that follow.
    """
    width, burst = stretch_minutes * 60_000_000, burst_seconds * 1_000_000
    if burst > width:
        raise ValueError("a stretch is shorter than the window of a burst")
    own = F.floor(F.col("_t") / width)
    rows = events.withColumn("_t", X.epoch_us("event_time")).withColumn("_own", own)
    rows = rows.withColumn("_stretch", F.explode(F.when((F.col("_own") + 1) * width - F.col("_t") <= burst, F.array("_own", F.col("_own") + 1)).otherwise(F.array("_own"))))
    inside = W.partitionBy("session_id", "_stretch")
    order, here = inside.orderBy("event_time", "event_uid"), F.col("_stretch") == F.col("_own")
    listing = F.coalesce(here & (F.col("event_name") == "ListBuckets"), F.lit(False))
    rows = rows.withColumns({
        "_at": F.count_if(here).over(order.rowsBetween(W.unboundedPreceding, 0)), "_lists": F.coalesce(F.max(listing).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(False)),
        "_n1": F.lead("action_category", 1).over(order), "_n2": F.lead("action_category", 2).over(order), "_m1": F.lead("event_name", 1).over(order),
        "_burst": F.count(F.lit(1)).over(inside.orderBy("_t").rangeBetween(-burst, 0)),
    }).where(here)
    first = F.array_sort(F.collect_list(F.when(F.col("_at") <= 2, F.struct("_at", F.col("event_name").alias("e"), F.col("action_category").alias("c")))))
    ends = rows.groupBy("session_id", "_stretch").agg(F.count("*").alias("_n"), F.max(listing).alias("_any"), first.alias("_first"))
    whole = W.partitionBy("session_id").orderBy("_stretch")  # a row a stretch
    before, none = whole.rowsBetween(W.unboundedPreceding, -1), F.array().cast(ends.schema["_first"].dataType)
    ends = ends.select(
        "session_id", "_stretch", "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.coalesce(F.max("_any").over(before), F.lit(False)).alias("_earlier"),
        F.concat(F.coalesce(F.lead("_first", 1).over(whole), none), F.coalesce(F.lead("_first", 2).over(whole), none)).alias("_next"),
    )
    follow = lambda i, field: F.get("_next", F.lit(i))[field]
    left = F.col("_n") - F.col("_at")  # events after it in the stretch
    out = rows.join(ends, ["session_id", "_stretch"]).withColumns({
        "_place": F.col("_at") + F.col("_before"), "_listed": F.col("_lists") | F.col("_earlier"), "_e2": F.when(left >= 1, F.col("_m1")).otherwise(follow(0, "e")),
        "_c2": F.when(left >= 1, F.col("_n1")).otherwise(follow(0, "c")), "_c3": F.when(left >= 2, F.col("_n2")).when(left == 1, follow(0, "c")).otherwise(follow(1, "c")),
    })
    return out.select(*events.columns, "_stretch", "_place", "_burst", "_listed", "_c2", "_c3", "_e2")


def key_action_minutes(category: str) -> Column:
    """An aggregate: minutes from a session's first Discovery to its first action of a category; null if there is none or it came before."""
    first = lambda c: F.min(F.when(F.col("action_category") == c, X.epoch_us("event_time")))
    found, done = first("Discovery"), first(category)
    return F.when(done >= found, (done - found) / 60e6)


def _sequence_key(column: str) -> Column:
    """An aggregate: 128 bits that name an ordered sequence, from the places and values of its rows in any order."""
    return F.struct(F.count("*").alias("n"), *(F.bit_xor(F.xxhash64(F.lit(lane), "_place", column)).alias(f"h{lane}") for lane in (1, 2)))


def _plain_features(burst: Column, first: Column) -> list[Column]:
    """Aggregates of a session's rows that need no order, with the two columns given in their places."""
    us, n, cat, name = X.epoch_us("event_time"), F.count(F.lit(1)), F.col("action_category"), F.col("event_name")
    minutes = F.greatest((F.max(us) - F.min(us)) / 60e6, F.lit(fixed.SINGLE_EVENT_MINUTES))
    count = lambda c: F.count_if(cat == c)
    return [
        F.first("identity_id").alias("identity_id"), F.min("event_time").alias("session_start"), F.max("event_time").alias("session_end"),
        minutes.alias("duration_minutes"), n.alias("num_events"), (n / minutes).alias("events_per_minute"), first,
        count("Discovery").alias("num_discovery_actions"), count("DataAccess").alias("num_data_access_actions"),
        *(count(c).alias(f"num_{name}_actions") for name, c, _ in fixed.SENSITIVE_WEIGHTS),
        F.count_if("is_failed").alias("num_failed_events"), (F.count_if("is_failed") / n).alias("failed_event_ratio"),
        F.count_if(name == "GetObject").alias("num_getobject_events"), F.count_if("is_sensitive").alias("num_sensitive_actions"), burst,
        key_action_minutes("PermissionChange").alias("minutes_discovery_to_permission_change"),
        key_action_minutes("CredentialAccess").alias("minutes_discovery_to_credential_access"),
        key_action_minutes("DataAccess").alias("minutes_discovery_to_data_access"),
    ]


DISTINCT = {"unique_services": "event_source", "unique_regions": "aws_region", "unique_source_ips": "source_ip"}
FEATURES = [
    "session_id", "identity_id", "session_start", "session_end", "duration_minutes", "num_events", "events_per_minute", *DISTINCT, "num_discovery_actions", "num_data_access_actions",
    *(f"num_{name}_actions" for name, _, _ in fixed.SENSITIVE_WEIGHTS), "num_failed_events", "failed_event_ratio", "num_getobject_events", "num_sensitive_actions", "max_events_in_5min", "reads_after_listing",
    "minutes_discovery_to_permission_change", "minutes_discovery_to_credential_access", "minutes_discovery_to_data_access", "event_sequence", "category_sequence", "first_events", "grams",
]
_ARROW = lambda *c: F.concat_ws(" -> ", *c)


def _by_length(events: DataFrame, short_events: int) -> tuple[DataFrame, DataFrame | None]:
    """The events of sessions of up to `short_events` events, and those of longer ones, if there are any."""
    rows = stored(events)  # counted, then read
    long = stored(rows.groupBy("session_id").agg(F.count("*").alias("_n")).where(F.col("_n") > short_events).select("session_id"))
    if long.isEmpty():
        return rows, None
    return rows.join(long, "session_id", "left_anti"), rows.join(long, "session_id", "left_semi")


def _short_features(events: DataFrame, burst_seconds: int = fixed.BURST_SECONDS) -> DataFrame:
    """FEATURES of sessions of few events: one aggregation, in which a session's events are one sorted array."""
    rows = events.where("event_time IS NOT NULL")
    entry = F.struct("event_time", "event_uid", X.epoch_us("event_time").alias("t"), F.col("event_name").alias("e"), F.col("action_category").alias("c"))
    out = rows.groupBy("session_id").agg(*_plain_features(F.array_sort(F.collect_list(entry)).alias("_all"), F.lit(None).alias("_none")), *(F.collect_set(c).alias(f"_{n}") for n, c in DISTINCT.items()))
    out = out.withColumns({"_e": F.col("_all.e"), "_c": F.col("_all.c"), "_t": F.col("_all.t")})
    listing = F.array_position("_e", F.lit("ListBuckets"))  # 0 where there is none
    place = lambda i: (i + 1).cast("long")

    def named(column: str) -> Column:
        hashed = lambda lane: F.aggregate(F.transform(column, lambda x, i: F.xxhash64(F.lit(lane), place(i), x)), F.lit(0).cast("long"), lambda a, h: a.bitwiseXOR(h))
        return F.struct(F.size(column).cast("long").alias("n"), *(hashed(lane).alias(f"h{lane}") for lane in (1, 2)))

    def runs(e: Column, i: Column) -> Column:
        c, c2, c3 = e["c"], F.get("_c", i + 1), F.get("_c", i + 2)
        kinds = {"category": c, "event": F.when(e["e"].isin(MARKED_EVENTS), e["e"]), "category2": F.when(c2.isNotNull(), _ARROW(c, c2)), "category3": F.when(c3.isNotNull(), _ARROW(c, c2, c3))}
        return F.array(*(F.struct(F.lit(k).alias("kind"), v.alias("gram"), place(i).alias("place"), e["e"].alias("call")) for k, v in kinds.items()))

    entries = F.filter(F.flatten(F.transform("_all", runs)), lambda r: r["gram"].isNotNull())
    burst = F.array_max(F.transform("_t", lambda t: F.size(F.filter("_t", lambda u: (u <= t) & (u >= t - burst_seconds * 1_000_000))))).cast("long")
    after = F.size(F.filter(F.transform("_e", lambda e, i: (e == "GetObject") & (place(i) > listing) & (listing > 0)), lambda x: F.coalesce(x, F.lit(False)))).cast("long")

    def gram(g: Column) -> Column:
        own = F.filter("_runs", lambda r: (r["kind"] == g["kind"]) & (r["gram"] == g["gram"]))
        calls = lambda o: F.transform(F.slice(o, 1, CALLS), lambda r: F.struct(r["place"].alias("place"), r["call"].alias("call")))
        whole = F.transform(F.array(own), lambda o: F.struct(
            g["kind"].alias("kind"), g["gram"].alias("gram"), F.size(o).cast("long").alias("n"), F.get(o, F.lit(0))["place"].alias("first"), F.element_at(o, -1)["place"].alias("last"), calls(o).alias("calls"),
        ))
        return F.get(whole, F.lit(0))

    out = out.withColumn("_runs", entries).withColumns({
        **{n: F.size(f"_{n}").cast("long") for n in DISTINCT}, "max_events_in_5min": burst, "reads_after_listing": after, "event_sequence": named("_e"), "category_sequence": named("_c"), "first_events": F.slice("_e", 1, 5),
        "grams": F.transform(F.array_distinct(F.transform("_runs", lambda r: F.struct(r["kind"].alias("kind"), r["gram"].alias("gram")))), gram),
    })
    return out.select(*FEATURES)


def _long_features(events: DataFrame, stretch_minutes: int) -> DataFrame:
    """FEATURES of sessions of any length, ordered by stretches."""
    name, place = F.col("event_name"), F.col("_place")
    cat = F.col("action_category")
    rows = stored(placed_events(events, stretch_minutes))  # ordered once; features and runs read it
    first = F.array_sort(F.collect_list(F.when(place <= 5, F.struct(place, name)))).alias("_first")
    out = rows.groupBy("session_id").agg(
        *_plain_features(F.max("_burst").alias("max_events_in_5min"), first), *(F.countDistinct(c).alias(n) for n, c in DISTINCT.items()), F.count_if((name == "GetObject") & F.col("_listed")).alias("reads_after_listing"),
        _sequence_key("event_name").alias("event_sequence"), _sequence_key("action_category").alias("category_sequence"),
    )
    kinds = {"category": cat, "event": F.when(name.isin(MARKED_EVENTS), name), "category2": F.when(F.col("_c2").isNotNull(), _ARROW(cat, "_c2")), "category3": F.when(F.col("_c3").isNotNull(), _ARROW(cat, "_c2", "_c3"))}
    each = F.explode(F.array_compact(F.array(*(F.when(v.isNotNull(), F.struct(F.lit(k).alias("kind"), v.alias("gram"))) for k, v in kinds.items()))))
    runs = rows.select("session_id", "_stretch", "_place", "event_name", each.alias("r")).select("session_id", "_stretch", "_place", "event_name", "r.kind", "r.gram")
    runs = runs.withColumn("_turn", F.row_number().over(W.partitionBy("session_id", "_stretch", "kind", "gram").orderBy("_place")))
    firsts = F.collect_list(F.when(F.col("_turn") <= CALLS, F.struct(F.col("_place").alias("place"), F.col("event_name").alias("call"))))
    parts = runs.groupBy("session_id", "_stretch", "kind", "gram").agg(F.count("*").alias("n"), F.min("_place").alias("first"), F.max("_place").alias("last"), firsts.alias("calls"))
    calls = F.slice(F.array_sort(F.flatten(F.collect_list("calls"))), 1, CALLS)  # CALLS entries a stretch
    grams = parts.groupBy("session_id", "kind", "gram").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"), calls.alias("calls"))
    grams = grams.groupBy("session_id").agg(F.collect_list(F.struct("kind", "gram", "n", "first", "last", "calls")).alias("grams"))
    return out.join(grams, "session_id").withColumn("first_events", F.col("_first.event_name")).select(*FEATURES)


def session_features(events: DataFrame, stretch_minutes: int = STRETCH_MINUTES, short_events: int = SHORT_EVENTS) -> DataFrame:
    """One row per session of `sessionize`d events.

    No column grows with a session's length: `first_events` holds five names;
    `event_sequence` and `category_sequence` name the whole sequences, for which
    see `session_sequences`; what scoring reads is aggregated from rows: `grams`
    has each distinct category and run of two and three of them and each
    operation that a rule names, `category_marks` and `event_marks` those of one
    kind, with count, first and last place and the places and names of the first
    CALLS events, places counting from 1.

    A session of up to `short_events` events is worked out from one sorted array
    in a single aggregation; only longer ones are ordered by stretches.
    """
    short, long = _by_length(events, short_events)
    out = _short_features(short) if long is None else _short_features(short).unionByName(_long_features(long, stretch_minutes))
    marks = lambda kind: F.map_from_entries(F.transform(F.filter("grams", lambda g: g["kind"] == kind), lambda g: F.struct(g["gram"], g)))
    return out.withColumns({"category_marks": marks("category"), "event_marks": marks("event")})


def session_sequences(events: DataFrame, piece_events: int = PIECE_EVENTS, stretch_minutes: int = STRETCH_MINUTES, short_events: int = SHORT_EVENTS) -> DataFrame:
    """(session_id, piece, event_names, action_categories): whole ordered sequences, in pieces of `piece_events` events from piece 0. Sessions of up to `short_events` events, if a piece holds as many, are sorted as one array."""
    short, long = _by_length(events, min(short_events, piece_events))
    p = F.array_sort(F.collect_list(F.struct("event_time", "event_uid", "event_name", "action_category")))
    out = short.where("event_time IS NOT NULL").groupBy("session_id").agg(p.alias("_p")).select("session_id", F.lit(0).cast("long").alias("piece"), F.col("_p.event_name").alias("event_names"), F.col("_p.action_category").alias("action_categories"))
    if long is None:
        return out
    piece = F.floor((F.col("_place") - 1) / piece_events).alias("piece")
    more = placed_events(long, stretch_minutes).groupBy("session_id", piece).agg(F.array_sort(F.collect_list(F.struct("_place", "event_name", "action_category"))).alias("_p"))
    return out.unionByName(more.select("session_id", "piece", F.col("_p.event_name").alias("event_names"), F.col("_p.action_category").alias("action_categories")))


# The global model: tables that scoring broadcasts or joins.


def ngram_counts(sessions: DataFrame, kind: str) -> DataFrame:
    """(gram, n) over all sessions; `kind` is category, category2 or category3."""
    return sessions.select(F.explode("grams").alias("g")).where(F.col("g.kind") == kind).groupBy("g.gram").agg(F.sum("g.n").alias("n"))


def operation_pair_counts(events: DataFrame) -> DataFrame:
    """(gram, n) of neighbouring operations in the sessions of `sessionize`d events."""
    return placed_events(events).where("_e2 IS NOT NULL").groupBy(F.concat_ws(" -> ", "event_name", "_e2").alias("gram")).agg(F.count("*").alias("n"))


def most_frequent(grams: DataFrame, keep: int = fixed.NGRAM_KEEP) -> DataFrame:
    """(gram, n, freq) of the `keep` most frequent of (gram, n); of equal counts the lesser text. freq is a share of all."""
    total = grams.agg(F.sum("n").alias("total"))
    return grams.crossJoin(F.broadcast(total)).withColumn("freq", F.col("n") / F.col("total")).drop("total").orderBy(F.desc("n"), "gram").limit(keep)


def ngram_frequencies(sessions: DataFrame, kind: str, keep: int = fixed.NGRAM_KEEP) -> DataFrame:
    return most_frequent(ngram_counts(sessions, kind), keep)


def transition_probabilities(sessions: DataFrame) -> DataFrame:
    """(src, dst, n, prob) of neighbouring categories."""
    split = F.split("gram", " -> ")
    out = ngram_counts(sessions, "category2").select(split[0].alias("src"), split[1].alias("dst"), "n")
    return out.withColumn("prob", F.col("n") / F.sum("n").over(W.partitionBy("src")))


def feature_distributions(sessions: DataFrame) -> DataFrame:
    """(feature, mean, std, p50, p90, p95, p99, min, max); population deviation, 1e-6 where there is none."""
    long = sessions.select(*(F.col(f).cast("double").alias(f) for f in fixed.DISTRIBUTION_FEATURES)).unpivot([], fixed.DISTRIBUTION_FEATURES, "feature", "x")
    out = long.groupBy("feature").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"))
    out = out.join(F.broadcast(grouped_quantiles(long, "feature", "x", (0.5, 0.9, 0.95, 0.99))), "feature", "left")  # a row a feature
    std = F.when(F.col("std") > 0, F.col("std")).otherwise(F.lit(1e-6))
    return out.select("feature", "mean", std.alias("std"), *(F.col("q")[i].alias(f"p{p}") for i, p in enumerate((50, 90, 95, 99))), "min", "max")


def common_sequences(sessions: DataFrame, events: DataFrame, kind: str, keep: int = fixed.SEQUENCE_KEEP) -> DataFrame:
    """(sequence, n) of the `keep` most frequent whole sequences, the lesser text of equal counts; `kind` is event or category.

    `sessions` are the features of `events`. Sequences are counted by their
    128-bit names; texts are put together for the `keep` that win alone. Where
    counts tie, sequences are compared by their first TIED_EVENTS events, and
    those that still tie at the border by four times as many, and so on.
    """
    value, key = {"event": "event_name", "category": "action_category"}[kind], f"{kind}_sequence"
    counts = sessions.groupBy(key).agg(F.count("*").alias("n"), F.min("session_id").alias("session_id")).select("session_id", "n", F.col(f"{key}.n").alias("length"))
    top = counts.orderBy(F.desc("n")).limit(keep).select("n").collect()
    if len(top) < keep:
        chosen, tied, wanted = counts, None, 0
    else:
        edge = top[-1].n
        chosen, tied, wanted = counts.where(F.col("n") > edge), counts.where(F.col("n") == edge), sum(r.n == edge for r in top)
    places = stored(placed_events(events).select("session_id", "_place", F.col(value).alias("_value")))  # read in every round

    def texts(of: DataFrame, most: int | None = None) -> DataFrame:
        rows = places if most is None else places.where(F.col("_place") <= most)
        return rows.join(of, "session_id").groupBy("session_id", "n", "length").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_place", "_value"))), lambda p: p["_value"]), " -> ").alias("sequence"))

    most = TIED_EVENTS
    while tied is not None and wanted:
        heads = texts(tied, most)
        border = heads.orderBy("sequence").limit(wanted).agg(F.max("sequence").alias("s"), F.max("length").alias("length")).first()
        tied = heads.where(F.col("sequence") <= F.lit(border.s)).select("session_id", "n", "length")
        found = tied.agg(F.count("*").alias("n"), F.max("length").alias("length")).first()
        if found.n <= wanted or found.length <= most:
            break
        most *= 4
    if tied is not None:
        chosen = chosen.unionByName(tied)
    return texts(chosen).orderBy(F.desc("n"), "sequence").limit(keep).select("sequence", "n")


class SessionModel:
    """What scoring needs of the baseline sessions: category 2- and 3-grams and the row of distributions."""

    def __init__(self, sessions: DataFrame, keep: int = fixed.NGRAM_KEEP):
        counted = F.transform(F.filter("grams", lambda g: g["kind"].isin("category2", "category3")), lambda g: F.struct(g["kind"].alias("kind"), g["gram"].alias("gram"), g["n"].alias("n")))
        sessions = stored(sessions.select(counted.alias("grams"), *fixed.DISTRIBUTION_FEATURES))  # read twice; without the grams' places and calls
        each = sessions.select(F.explode("grams").alias("g"))
        counts = each.groupBy("g.kind", "g.gram").agg(F.sum("g.n").alias("n"))  # as many as categories have pairs and triples; both in one pass over the sessions
        kind = W.partitionBy("kind")
        ranked = counts.withColumns({"freq": F.col("n") / F.sum("n").over(kind), "_place": F.row_number().over(kind.orderBy(F.desc("n"), "gram"))})
        self.grams = ranked.where(F.col("_place") <= keep).select("gram", "n", "freq")
        wide = feature_distributions(sessions).groupBy(F.lit(1).alias("_one"))
        self.distributions = wide.agg(F.map_from_entries(F.collect_list(F.struct("feature", F.struct("mean", "std", "p95")))).alias("dist")).select("dist")


# Scoring. Each component adds its score and its lists of reasons and evidence.


def _calls(category: str | Column, n: int) -> Column:
    """The first n calls of a category in a session, joined."""
    mark = F.try_element_at("category_marks", F.lit(category) if isinstance(category, str) else category)
    return F.coalesce(F.array_join(F.slice(mark["calls"]["call"], 1, n), ", "), F.lit(""))


def _follows(marks: str, a: str, b: str) -> Column:
    """Whether some b comes after the first a."""
    return F.coalesce(F.try_element_at(marks, F.lit(a))["first"] < F.try_element_at(marks, F.lit(b))["last"], F.lit(False))


def score_rarity(sessions: DataFrame, model: SessionModel) -> DataFrame:
    """0 to 25: the mean of 1 - frequency over all 2- and 3-grams of categories; up to three that the baseline never saw are evidence."""
    frequencies = model.grams.agg(F.map_from_entries(F.collect_list(F.struct("gram", "freq"))).alias("_freq"))  # twice NGRAM_KEEP entries at most
    out = sessions.crossJoin(F.broadcast(frequencies)).withColumn("_grams", F.filter("grams", lambda g: g["kind"].isin("category2", "category3")))
    rare = F.aggregate("_grams", F.lit(0.0), lambda a, g: a + g["n"] * (1 - F.coalesce(F.try_element_at("_freq", g["gram"]), F.lit(0.0))))
    total = F.aggregate("_grams", F.lit(0).cast("long"), lambda a, g: a + g["n"])
    new = F.filter("_grams", lambda g: F.try_element_at("_freq", g["gram"]).isNull())
    places = F.array_sort(F.flatten(F.transform(new, lambda g: F.transform(F.slice(g["calls"], 1, 3), lambda p: F.struct(g["kind"].alias("kind"), p["place"].alias("p"), g["gram"].alias("gram"))))))
    unseen = F.slice(places["gram"], 1, 3)
    calls = lambda c: F.concat(c, F.lit(":["), _calls(c, 3), F.lit("]"))
    evidence = F.transform(unseen, lambda g: F.concat(F.lit("RARE_SEQUENCE: "), F.array_join(F.transform(F.split(g, " -> "), calls), " -> ")))
    text = F.concat(F.lit("contains rare action chain(s) never seen in baseline: "), F.array_join(unseen, ", "))
    return out.withColumns({
        "sequence_rarity_score": F.when(total > 0, F.least(rare / total * 25, F.lit(25.0))).otherwise(F.lit(0.0)),
        "_rarity_reasons": X.compact(F.when(F.size(unseen) > 0, text)), "_rarity_flags": evidence,
    }).drop("_freq", "_grams")


def score_chains(sessions: DataFrame) -> DataFrame:
    """0 to 30: category pairs 6, triples 4, event pairs 5, bulk reads after a listing 6, evasion before all else 8."""
    rules: list[tuple[Column, float, Column, Column]] = []
    calls = lambda c: F.concat(F.lit("["), _calls(c, 3), F.lit("]"))
    first = lambda c: F.try_element_at("category_marks", F.lit(c))["first"]
    arrow = F.lit(" -> ")
    for a, b in fixed.CATEGORY_CHAINS:
        rules.append((_follows("category_marks", a, b), 6.0, F.lit(f"{a} -> {b} chain present"), F.concat(F.lit(f"CHAIN {a}->{b}: "), calls(a), arrow, calls(b))))
    for a, b, c in fixed.CATEGORY_TRIPLES:
        holds = F.coalesce(first(a) < first(b), F.lit(False)) & _follows("category_marks", b, c)
        rules.append((holds, 4.0, F.lit(f"{a} -> {b} -> {c} chain present"), F.concat(F.lit(f"TRIPLE {a}->{b}->{c}: "), calls(a), arrow, calls(b), arrow, calls(c))))
    for a, b in fixed.EVENT_PAIRS:
        rules.append((_follows("event_marks", a, b), 5.0, F.lit(f"{a} followed by {b}"), F.lit(f"EVENT_PAIR: {a} -> {b}")))
    after = F.col("reads_after_listing")
    rules.append((
        after >= 5, 6.0, F.concat(F.lit("ListBuckets followed by "), after.cast("string"), F.lit(" GetObject calls (bulk access)")),
        F.concat(F.lit("BULK_ACCESS: ListBuckets -> GetObject x"), after.cast("string")),
    ))
    rules.append((
        F.coalesce(first("DefenseEvasion") == 1, F.lit(False)) & (F.col("num_events") > 1), 8.0, F.lit("DefenseEvasion action occurred before other activity in the session"),
        F.concat(F.lit("DEFENSE_EVASION_FIRST: "), _calls("DefenseEvasion", 1), F.lit(" preceded all other actions")),
    ))
    return _component(sessions, "suspicious_chain_score", "_chain", rules, 30.0)


def _component(sessions: DataFrame, name: str, short: str, rules: list[tuple[Column, Column | float, Column, Column]], most: float) -> DataFrame:
    total = F.lit(0.0)
    for holds, value, _, _ in rules:
        total = total + F.when(holds, value if isinstance(value, Column) else F.lit(value)).otherwise(F.lit(0.0))
    return sessions.withColumns({
        name: F.least(total, F.lit(most)), f"{short}_reasons": X.compact(*(F.when(h, t) for h, _, t, _ in rules)), f"{short}_flags": X.compact(*(F.when(h, e) for h, _, _, e in rules)),
    })


def score_timing(sessions: DataFrame) -> DataFrame:
    """0 to 20: rates beyond the baseline's p95 and quick steps from Discovery. Needs `dist`."""
    rules = []
    head = F.concat(F.array_join(F.col("first_events"), ", "), F.when(F.col("num_events") > 5, F.lit("...")).otherwise(F.lit("")))
    for feature in ("events_per_minute", "max_events_in_5min"):
        p95, value = F.col("dist")[feature]["p95"], F.col(feature).cast("double")
        rules.append((
            (p95 > 0) & (value > p95), 7 * (F.least(value / p95, F.lit(3.0)) - 1) / 2, F.format_string(f"{feature}=%.2f exceeds baseline p95 (%.2f)", value, p95),
            F.concat(F.format_string(f"BURST_RATE ({feature}=%.2f vs p95=%.2f): [", value, p95), head, F.lit("]")),
        ))
    for name, category in (("permission_change", "PermissionChange"), ("credential_access", "CredentialAccess"), ("data_access", "DataAccess")):
        value = F.col(f"minutes_discovery_to_{name}")
        rules.append((
            F.coalesce(value <= 10, F.lit(False)), 6.0, F.format_string(f"fast progression from Discovery to {category} in %.1f minutes", value),
            F.concat(F.format_string("FAST_PROGRESSION (%.1fmin): ", value), _calls("Discovery", 1), F.lit(" -> ... -> "), _calls(category, 1)),
        ))
    return _component(sessions, "timing_burst_score", "_timing", rules, 20.0)


def score_deviation(sessions: DataFrame) -> DataFrame:
    """0 to 15: the mean of six absolute z-scores, a quarter of it times 15. Needs `dist`."""
    z = {f: F.abs((F.col(f) - F.col("dist")[f]["mean"]) / F.col("dist")[f]["std"]) for f in fixed.DEVIATION_FEATURES}
    total = F.lit(0.0)
    for v in z.values():
        total = total + v
    rules = [(v > 3, F.format_string(f"{f}=%.2f is far from baseline (z=%.1f)", F.col(f).cast("double"), v), F.format_string(f"DEVIATION {f}=%.2f (z=%.1f, baseline_mean=%.2f)", F.col(f).cast("double"), v, F.col("dist")[f]["mean"])) for f, v in z.items()]
    return sessions.withColumns({
        "feature_deviation_score": F.least(total / len(z) / 4 * 15, F.lit(15.0)),
        "_deviation_reasons": X.compact(*(F.when(h, t) for h, t, _ in rules)), "_deviation_flags": X.compact(*(F.when(h, e) for h, _, e in rules)),
    })


def score_sensitive(sessions: DataFrame) -> DataFrame:
    """0 to 10: actions of sensitive categories, each up to twice its weight, and 2 for twenty data accesses."""
    rules = []
    for name, category, weight in fixed.SENSITIVE_WEIGHTS:
        n = F.col(f"num_{name}_actions")
        rules.append((n > 0, F.least(n * weight, F.lit(2 * weight)), F.concat(n.cast("string"), F.lit(f" {name} action(s)")), F.concat(F.lit(f"SENSITIVE {category} (x"), n.cast("string"), F.lit("): "), _calls(category, CALLS))))
    n = F.col("num_data_access_actions")
    rules.append((n >= 20, 2.0, F.concat(F.lit("high-volume data access ("), n.cast("string"), F.lit(" events)")), F.concat(F.lit("HIGH_VOLUME_DATA_ACCESS (x"), n.cast("string"), F.lit("): "), _calls("DataAccess", 5), F.lit("..."))))
    return _component(sessions, "sensitive_action_score", "_sensitive", rules, 10.0)


COMPONENTS = ("sequence_rarity_score", "suspicious_chain_score", "timing_burst_score", "feature_deviation_score", "sensitive_action_score")


def score_sessions(sessions: DataFrame, model: SessionModel) -> DataFrame:
    """Add the five components, session_risk_score (0 to 100), risk_explanation and flagged_api_sequences."""
    out = score_chains(score_rarity(sessions, model)).crossJoin(F.broadcast(model.distributions))
    out = score_sensitive(score_deviation(score_timing(out)))
    total = F.lit(0.0)
    for c in COMPONENTS:
        total = total + F.col(c)
    out = out.withColumn("session_risk_score", F.least(F.greatest(total, F.lit(0.0)), F.lit(100.0)))
    shorts = ("_rarity", "_chain", "_timing", "_deviation", "_sensitive")
    told = F.concat(*(F.col(f"{s}_reasons") for s in shorts))
    flags = F.concat(*(F.col(f"{s}_flags") for s in shorts))
    band = F.when(F.col("session_risk_score") >= fixed.SESSION_HIGH, "high").when(F.col("session_risk_score") >= fixed.SESSION_MEDIUM, "medium").otherwise("low")
    text = F.concat(
        F.lit("This session is "), band, F.lit(" risk because it "), F.array_join(F.slice(told, 1, 5), "; "), F.lit(", within a "),
        F.format_string("%.1f", F.col("duration_minutes")), F.lit("-minute window ("), F.col("num_events").cast("string"), F.lit(" events)."),
    )
    return out.withColumns({
        "risk_explanation": F.when(F.size(told) == 0, F.lit("This session matches normal baseline behavior; no notable risk signals.")).otherwise(text),
        "flagged_api_sequences": F.when(F.size(flags) == 0, F.lit("none")).otherwise(F.array_join(flags, " | ")),
    }).drop("dist", *(f"{s}_{k}" for s in shorts for k in ("reasons", "flags")))


def top_sessions(scored: DataFrame, n: int = fixed.TOP_SESSIONS) -> DataFrame:
    return scored.orderBy(F.desc("session_risk_score"), "session_id").limit(n)


def risk_bands(scored: DataFrame) -> DataFrame:
    """Sessions, identities and events in all, and sessions per band."""
    r = F.col("session_risk_score")
    return scored.agg(
        F.count("*").alias("sessions"), F.countDistinct("identity_id").alias("identities"), F.sum("num_events").alias("events"),
        F.count_if(r >= fixed.SESSION_HIGH).alias("high"), F.count_if((r >= fixed.SESSION_MEDIUM) & (r < fixed.SESSION_HIGH)).alias("medium"), F.count_if(r < fixed.SESSION_MEDIUM).alias("low"),
    )
