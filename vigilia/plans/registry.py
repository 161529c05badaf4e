"""Registered queries over the driver's tables, each beside its DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilia.functions import exprs as X
from vigilia.functions import fixed
from vigilia.operators import baseline as B
from vigilia.operators import curves as C
from vigilia.operators import exfil as E
from vigilia.operators import findings as R
from vigilia.operators import incremental as I
from vigilia.operators import normalize as N
from vigilia.operators import sessions as S
from vigilia.operators import ueba as U
from vigilia.plans import driver_tables as D
from vigilia.plans.sql import query
from vigilia.sources import logs, stored, tables

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def register(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = query(sql)
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _same(name: str) -> Callable[[Query], Query]:
    """Register a query whose counterpart is that of another."""

    def add(f: Query) -> Query:
        _QUERIES[f.__name__], _SQL[f.__name__] = f, _SQL[name]
        return f

    return add


def rounded(frame: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded, for results whose sums may run in any order."""
    return frame.select(*(X.settled(F.col(f.name), places).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in frame.schema.fields))


def us(name: str):
    return X.epoch_us(name).alias(name)


def _r(*names: str, places: int = 6) -> str:
    return ", ".join(f"round(round({n}, 10), {places}) AS {n}" for n in names)


# Events and sessions.


def _sessions(spark: SparkSession, sf_dir: str, part: str = "all") -> DataFrame:
    rows = D.session_events(spark, sf_dir)
    if part != "all":
        before, after = E.split_at(rows, D.CUTOFF)
        rows = before if part == "base" else after
    return S.sessionize(rows, D.GAP_MINUTES)


def _features(spark: SparkSession, sf_dir: str, part: str = "all") -> DataFrame:
    return S.session_features(_sessions(spark, sf_dir, part))


@register("SELECT event_uid AS event_id, session_id, session_number FROM xs")
def sessionize(spark, sf_dir):
    return _sessions(spark, sf_dir).select(F.col("event_uid").alias("event_id"), "session_id", "session_number")


@register("SELECT event_uid AS event_id, session_id, session_number FROM xs")
def sessionize_stitched(spark, sf_dir):
    return S.sessionize(D.session_events(spark, sf_dir), D.GAP_MINUTES, bucket_days=3).select(F.col("event_uid").alias("event_id"), "session_id", "session_number")


_COUNTS = [
    "num_events", "unique_services", "unique_regions", "unique_source_ips", "num_discovery_actions", "num_data_access_actions", "num_permission_change_actions", "num_credential_access_actions",
    "num_persistence_actions", "num_defense_evasion_actions", "num_failed_events", "num_getobject_events", "num_sensitive_actions",
]


@register(f"SELECT session_id, identity_id, epoch_us(session_start) AS session_start, epoch_us(session_end) AS session_end, {_r('duration_minutes', 'events_per_minute', 'failed_event_ratio')}, {', '.join(_COUNTS)}, categories, operations FROM xf")
def session_features(spark, sf_dir):
    events = _sessions(spark, sf_dir)
    shown = S.session_sequences(events).groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("piece", *(F.array_join(c, " -> ").alias(c) for c in ("action_categories", "event_names"))))).alias("p"))
    out = S.session_features(events).select("session_id", "identity_id", us("session_start"), us("session_end"), "duration_minutes", "events_per_minute", "failed_event_ratio", *_COUNTS)
    return rounded(out.join(shown, "session_id").select(*out.columns, F.array_join("p.action_categories", " -> ").alias("categories"), F.array_join("p.event_names", " -> ").alias("operations")))


@register("SELECT session_id, max_events_in_5min FROM xf")
def session_burst(spark, sf_dir):
    return _features(spark, sf_dir).select("session_id", "max_events_in_5min")


_MINUTES = ["minutes_discovery_to_permission_change", "minutes_discovery_to_credential_access", "minutes_discovery_to_data_access"]


@register(f"SELECT session_id, {_r(*_MINUTES, places=4)} FROM xf")
def session_key_action_minutes(spark, sf_dir):
    return rounded(_features(spark, sf_dir).select("session_id", *_MINUTES), 4)


@register("SELECT category, count(*) AS n FROM ev GROUP BY category")
def action_category(spark, sf_dir):
    return D.api_events(spark, sf_dir).groupBy(X.action_category("operation").alias("category")).agg(F.count("*").alias("n"))


@register("SELECT operation, sensitive, count(*) AS n FROM ev GROUP BY ALL")
def sensitive_flag(spark, sf_dir):
    return D.api_events(spark, sf_dir).groupBy("operation", X.is_sensitive("operation").alias("sensitive")).agg(F.count("*").alias("n"))


_CRUD = " ".join(f"WHEN regexp_matches(lower(operation), '^({'|'.join(p)})') THEN {k}" for k, p in fixed.CRUD_PREFIXES.items())


@register(f"SELECT operation, CASE WHEN operation IS NULL OR operation = '' THEN 0 {_CRUD} ELSE 99 END AS crud, count(*) AS n FROM ev GROUP BY ALL")
def crud_class(spark, sf_dir):
    return D.api_events(spark, sf_dir).groupBy("operation", X.crud_class("operation").alias("crud")).agg(F.count("*").alias("n"))


@register("SELECT operation, service, count(*) AS n FROM ev GROUP BY ALL")
def service_inference(spark, sf_dir):
    return D.session_events(spark, sf_dir).groupBy(F.col("event_name").alias("operation"), F.col("event_source").alias("service")).agg(F.count("*").alias("n"))


def _top(source: str, total: str) -> str:
    return f"SELECT gram, n, round(n / (SELECT sum(n) FROM {total}), 6) AS freq FROM {source} ORDER BY n DESC, gram LIMIT {fixed.NGRAM_KEEP}"


@register(_top("grams2", "grams2"))
def category_bigrams(spark, sf_dir):
    return rounded(S.ngram_frequencies(_features(spark, sf_dir, "base"), "category2"))


@register(_top("grams3", "grams3"))
def category_trigrams(spark, sf_dir):
    return rounded(S.ngram_frequencies(_features(spark, sf_dir, "base"), "category3"))


@register(f"SELECT operation || ' -> ' || o2 AS gram, count(*) AS n, round(count(*) / (SELECT count(*) FROM bs WHERE o2 IS NOT NULL), 6) AS freq FROM bs WHERE o2 IS NOT NULL GROUP BY 1 ORDER BY n DESC, gram LIMIT {fixed.NGRAM_KEEP}")
def event_bigrams(spark, sf_dir):
    return rounded(S.most_frequent(S.operation_pair_counts(_sessions(spark, sf_dir, "base"))))


@register("SELECT category AS src, c2 AS dst, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY category), 6) AS prob FROM bs WHERE c2 IS NOT NULL GROUP BY 1, 2")
def transition_probs(spark, sf_dir):
    return rounded(S.transition_probabilities(_features(spark, sf_dir, "base")))


@register(f"SELECT feature, {_r('mean', 'std', 'p50', 'p90', 'p95', 'p99', 'min', 'max', places=4)} FROM dist")
def feature_distributions(spark, sf_dir):
    return rounded(S.feature_distributions(_features(spark, sf_dir, "base")), 4)


@register(f"SELECT categories AS sequence, count(*) AS n FROM bf GROUP BY 1 ORDER BY n DESC, sequence LIMIT {fixed.SEQUENCE_KEEP}")
def common_sequences(spark, sf_dir):
    return S.common_sequences(_features(spark, sf_dir, "base"), _sessions(spark, sf_dir, "base"), "category")


@register(f"SELECT operations AS sequence, count(*) AS n FROM bf GROUP BY 1 ORDER BY n DESC, sequence LIMIT {fixed.SEQUENCE_KEEP}")
def common_event_sequences(spark, sf_dir):
    return S.common_sequences(_features(spark, sf_dir, "base"), _sessions(spark, sf_dir, "base"), "event")


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.score_sessions(_features(spark, sf_dir, "cur"), S.SessionModel(_features(spark, sf_dir, "base")))


@register(f"SELECT session_id, {_r('sequence_rarity_score', places=4)} FROM risk")
def session_rarity(spark, sf_dir):
    return rounded(S.score_rarity(_features(spark, sf_dir, "cur"), S.SessionModel(_features(spark, sf_dir, "base"))).select("session_id", "sequence_rarity_score"), 4)


@register(f"SELECT session_id, {_r('suspicious_chain_score', places=4)} FROM chain")
def session_chain(spark, sf_dir):
    return rounded(S.score_chains(_features(spark, sf_dir, "cur")).select("session_id", "suspicious_chain_score"), 4)


@register(f"SELECT session_id, {_r('timing_burst_score', places=4)} FROM timing")
def session_timing(spark, sf_dir):
    return rounded(_scored(spark, sf_dir).select("session_id", "timing_burst_score"), 4)


@register(f"SELECT session_id, {_r('feature_deviation_score', places=4)} FROM deviant")
def session_deviation(spark, sf_dir):
    return rounded(_scored(spark, sf_dir).select("session_id", "feature_deviation_score"), 4)


@register(f"SELECT session_id, {_r('sensitive_action_score', places=4)} FROM sensi")
def session_sensitive(spark, sf_dir):
    return rounded(S.score_sensitive(_features(spark, sf_dir, "cur")).select("session_id", "sensitive_action_score"), 4)


@register(f"SELECT session_id, identity_id, {_r('session_risk_score', places=4)} FROM risk")
def session_risk(spark, sf_dir):
    return rounded(_scored(spark, sf_dir).select("session_id", "identity_id", "session_risk_score"), 4)


@register(f"SELECT session_id, {_r('session_risk_score', places=4)} FROM risk ORDER BY risk.session_risk_score DESC, session_id LIMIT {fixed.TOP_SESSIONS}")
def session_top(spark, sf_dir):
    return rounded(S.top_sessions(_scored(spark, sf_dir)).select("session_id", "session_risk_score"), 4)


@register("SELECT session_id, risk_explanation, flagged_api_sequences FROM explained")
def session_explain(spark, sf_dir):
    return _scored(spark, sf_dir).select("session_id", "risk_explanation", "flagged_api_sequences")


_CLASS = "CASE WHEN regexp_matches(item, '^(CHAIN|TRIPLE|EVENT_PAIR|BULK_ACCESS|DEFENSE_EVASION)') THEN 'chain' WHEN item LIKE 'RARE%' THEN 'rare' WHEN regexp_matches(item, '^(BURST|FAST)') THEN 'timing' WHEN item LIKE 'DEVIATION%' THEN 'deviate' ELSE 'sensitive' END"


@register(f"SELECT {_CLASS} AS class, count(*) AS items, count(DISTINCT session_id) AS sessions FROM (SELECT session_id, unnest(string_split(flagged_api_sequences, ' | ')) AS item FROM explained WHERE flagged_api_sequences <> 'none') GROUP BY 1")
def session_evidence(spark, sf_dir):
    return R.evidence_items(_scored(spark, sf_dir)).groupBy("class").agg(F.count("*").alias("items"), F.countDistinct("session_id").alias("sessions"))


@register(f"SELECT count(*) AS sessions, count(DISTINCT identity_id) AS identities, CAST(sum(num_events) AS BIGINT) AS events, count(*) FILTER (session_risk_score >= {fixed.SESSION_HIGH}) AS high, count(*) FILTER (session_risk_score >= {fixed.SESSION_MEDIUM} AND session_risk_score < {fixed.SESSION_HIGH}) AS medium, count(*) FILTER (session_risk_score < {fixed.SESSION_MEDIUM}) AS low FROM risk")
def risk_bands(spark, sf_dir):
    return S.risk_bands(_scored(spark, sf_dir))


# Baselines and profiles.


def _base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.split_at(D.api_events(spark, sf_dir), D.CUTOFF)[0]


def _current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.split_at(D.api_events(spark, sf_dir), D.CUTOFF)[1]


@register("SELECT actor, hour, n FROM hcount")
def baseline_hours(spark, sf_dir):
    return B.hour_counts(_base(spark, sf_dir))


@register("SELECT actor, mean, std, slots FROM hslots")
def baseline_hour_slots(spark, sf_dir):
    return B.slot_stats(_base(spark, sf_dir), "hour")


@register("SELECT actor, mean, std, slots FROM dslots")
def baseline_daily_stats(spark, sf_dir):
    return B.slot_stats(_base(spark, sf_dir), "day")


_LONG = " UNION ALL ".join(f"SELECT actor, '{k}' AS kind, {k} AS value, event_time FROM base" for k in ("operation", "ip", "region", "resource"))


@register(f"SELECT actor, kind, value, count(*) AS n, epoch_us(min(event_time)) AS first_seen, epoch_us(max(event_time)) AS last_seen FROM ({_LONG}) GROUP BY actor, kind, value")
def baseline_sets(spark, sf_dir):
    return B.known_values(_base(spark, sf_dir)).select("actor", "kind", "value", "n", us("first_seen"), us("last_seen"))


@register("SELECT actor, operation, count(*) AS n FROM base GROUP BY ALL")
def baseline_ops(spark, sf_dir):
    return B.operation_counts(_base(spark, sf_dir))


_SETS = "(SELECT actor, string_agg(DISTINCT ip, ',' ORDER BY ip) AS known_ips, string_agg(DISTINCT region, ',' ORDER BY region) AS known_regions, string_agg(DISTINCT resource, ',' ORDER BY resource) AS known_resources, count(*) AS event_count, arg_min(is_system, (event_time, event_uid)) AS is_system FROM base GROUP BY actor)"


@register(f"SELECT s.*, h.mean AS volume_mean, h.std AS volume_std, h.slots AS active_slots, d.mean AS daily_mean, d.std AS daily_std FROM {_SETS} s JOIN hslots h USING (actor) JOIN dslots d USING (actor)")
def ct_baseline(spark, sf_dir):
    return _ct_columns(B.api_baseline(_base(spark, sf_dir)))


def _ct_columns(baseline: DataFrame) -> DataFrame:
    return baseline.select(
        "actor", *(F.array_join(c, ",").alias(c) for c in ("known_ips", "known_regions", "known_resources")), "event_count", "is_system",
        F.col("volume_stats.mean").alias("volume_mean"), F.col("volume_stats.std").alias("volume_std"), F.col("volume_stats.slots").alias("active_slots"), F.col("daily_events.mean").alias("daily_mean"), F.col("daily_events.std").alias("daily_std"),
    )


def _by_day(spark: SparkSession, partials: DataFrame) -> DataFrame:
    """Partials stored a day a folder; the first three days are written once more, which must leave all others as they are."""
    path = stored.shared_folder(spark)
    tables.write_days(partials, path)
    days = [r.day for r in tables.read_days(spark, path, schema=I.PARTIAL).select("day").distinct().orderBy("day").limit(3).collect()]
    tables.write_days(partials.where(F.col("day").isin(days)), path)
    return tables.read_days(spark, path, schema=I.PARTIAL)


@_same("ct_baseline")
def merged_ct_baseline(spark, sf_dir):
    return _ct_columns(I.api_baseline_of(_by_day(spark, I.api_partials(_base(spark, sf_dir)))))


@register("SELECT actor, kind, value, count(*) AS n, epoch_us(min(event_time)) AS first_seen, epoch_us(max(event_time)) AS last_seen FROM (" + _LONG + ") GROUP BY actor, kind, value UNION ALL SELECT actor, 'hour', CAST(hour AS VARCHAR), n, NULL, NULL FROM hcount")
def merged_values(spark, sf_dir):
    whole = I.merged(_by_day(spark, I.api_partials(_base(spark, sf_dir)))).where(F.col("kind").isin("operation", "ip", "region", "resource", "hour"))
    seen = lambda c: F.when(F.col("kind") != "hour", X.epoch_us(c)).alias(c)
    return whole.select("actor", "kind", "value", "n", seen("first_seen"), seen("last_seen"))


def _split_table(frame: DataFrame) -> tuple[DataFrame, DataFrame]:
    return E.split_at(frame, D.TRADE_CUTOFF)


@register("SELECT b.*, e.mean AS events_mean, e.std AS events_std, v.mean AS bytes_mean, v.std AS bytes_std FROM (SELECT actor, string_agg(DISTINCT operation, ',' ORDER BY operation) AS known_operations, string_agg(DISTINCT bucket, ',' ORDER BY bucket) AS known_buckets, string_agg(DISTINCT ip, ',' ORDER BY ip) AS known_ips, count(*) AS event_count FROM abase GROUP BY actor) b JOIN adaye e USING (actor) JOIN adayb v USING (actor)")
def s3_baseline(spark, sf_dir):
    return _s3_columns(B.access_baseline(_split_table(D.accesses(spark, sf_dir))[0]))


@_same("s3_baseline")
def merged_s3_baseline(spark, sf_dir):
    return _s3_columns(I.access_baseline_of(stored.stored(I.access_partials(_split_table(D.accesses(spark, sf_dir))[0]))))


def _s3_columns(out: DataFrame) -> DataFrame:
    return out.select(
        "actor", *(F.array_join(c, ",").alias(c) for c in ("known_operations", "known_buckets", "known_ips")), "event_count",
        F.col("daily_events.mean").alias("events_mean"), F.col("daily_events.std").alias("events_std"), F.col("daily_bytes.mean").alias("bytes_mean"), F.col("daily_bytes.std").alias("bytes_std"),
    )


@register("SELECT b.*, e.mean AS flows_mean, e.std AS flows_std, v.mean AS bytes_mean, v.std AS bytes_std FROM (SELECT eni, string_agg(DISTINCT dst_ip, ',' ORDER BY dst_ip) AS known_dst_ips, count(DISTINCT dst_ip || ':' || dst_port) AS connections, string_agg(DISTINCT protocol::VARCHAR, ',' ORDER BY protocol::VARCHAR) AS known_protocols, count(*) AS event_count FROM fbase GROUP BY eni) b JOIN fdaye e USING (eni) JOIN fdayb v USING (eni)")
def vpc_baseline(spark, sf_dir):
    return _vpc_columns(B.flow_baseline(_split_table(D.flows(spark, sf_dir))[0], "eni"))


@_same("vpc_baseline")
def merged_vpc_baseline(spark, sf_dir):
    partials = I.flow_partials(_split_table(D.flows(spark, sf_dir))[0], "eni")
    return _vpc_columns(I.flow_baseline_of(stored.stored(partials)).withColumnRenamed("actor", "eni"))


def _vpc_columns(out: DataFrame) -> DataFrame:
    return out.select(
        "eni", F.array_join("known_dst_ips", ",").alias("known_dst_ips"), F.size("known_dst_conns").cast("long").alias("connections"), F.array_join(F.col("known_protocols").cast("array<string>"), ",").alias("known_protocols"), "event_count",
        F.col("daily_flows.mean").alias("flows_mean"), F.col("daily_flows.std").alias("flows_std"), F.col("daily_bytes.mean").alias("bytes_mean"), F.col("daily_bytes.std").alias("bytes_std"),
    )


_ACTORS = "(SELECT ip AS src_ip, arg_max(actor, (event_time, event_uid)) AS actor FROM ev GROUP BY ip)"


@register(f"SELECT eni, arg_min(a.actor, s.src_ip) AS actor, min(CASE WHEN a.actor IS NOT NULL THEN s.src_ip END) AS resolved_ip FROM (SELECT DISTINCT eni, src_ip FROM fl) s LEFT JOIN {_ACTORS} a USING (src_ip) GROUP BY eni")
def interface_actors(spark, sf_dir):
    return B.resolve_interfaces(D.flows(spark, sf_dir), B.last_actor_by_ip(D.api_events(spark, sf_dir)))


_FLOWS = "count(*) AS event_count, CAST(sum(bytes) AS BIGINT) AS bytes_total, max(bytes) AS bytes_max, CASE WHEN max(bytes) > 0 THEN epoch_us(arg_max(event_time, (bytes, -epoch_us(event_time)))) END AS bytes_max_time, count(*) FILTER (action = 'REJECT') AS reject_count, epoch_us(min(event_time)) AS first_seen, epoch_us(max(event_time)) AS last_seen, string_agg(DISTINCT dst_ip, ',' ORDER BY dst_ip) AS dst_ips, string_agg(DISTINCT protocol::VARCHAR, ',' ORDER BY protocol::VARCHAR) AS protocols"


def _flow_columns(profile: DataFrame, by: str) -> DataFrame:
    return profile.select(
        by, "event_count", "bytes_total", "bytes_max", us("bytes_max_time"), "reject_count", us("first_seen"), us("last_seen"), F.array_join("dst_ips", ",").alias("dst_ips"),
        F.array_join(F.col("protocols").cast("array<string>"), ",").alias("protocols"),
    )


@register(f"SELECT eni, {_FLOWS} FROM fcur GROUP BY eni")
def vpc_entity_profile(spark, sf_dir):
    return _flow_columns(B.flow_profile(_split_table(D.flows(spark, sf_dir))[1], ["eni"]), "eni")


@register(f"SELECT actor, {_FLOWS} FROM (SELECT f.*, coalesce(a.actor, e.actor, f.eni) AS actor FROM fcur f LEFT JOIN {_ACTORS} a USING (src_ip) LEFT JOIN (SELECT eni, arg_max(a.actor, (f.event_time, src_ip)) AS actor FROM fcur f JOIN {_ACTORS} a USING (src_ip) GROUP BY eni) e USING (eni)) GROUP BY actor")
def vpc_actor_profile(spark, sf_dir):
    flows = B.resolve_flows(_split_table(D.flows(spark, sf_dir))[1], B.last_actor_by_ip(D.api_events(spark, sf_dir)))
    return _flow_columns(B.flow_profile(flows, ["actor"]), "actor")


@register("SELECT eni, dst_port, count(*) AS n FROM fcur GROUP BY eni, dst_port HAVING count(*) > 1")
def vpc_repeated_ports(spark, sf_dir):
    out = B.flow_profile(_split_table(D.flows(spark, sf_dir))[1], ["eni"])
    return out.select("eni", F.explode(F.filter("port_counts", lambda x: x["n"] > 1)).alias("e")).select("eni", "e.dst_port", "e.n")


@register("SELECT actor, count(*) AS event_count, CAST(sum(bytes) AS BIGINT) AS bytes_total, max(bytes) AS bytes_max, CASE WHEN max(bytes) > 0 THEN epoch_us(arg_max(event_time, (bytes, -epoch_us(event_time)))) END AS bytes_max_time, count(*) FILTER (code <> 200) AS error_count, string_agg(DISTINCT operation, ',' ORDER BY operation) AS known_operations, string_agg(DISTINCT bucket, ',' ORDER BY bucket) AS known_buckets, string_agg(DISTINCT ip, ',' ORDER BY ip) AS known_ips FROM acur GROUP BY actor")
def s3_profile(spark, sf_dir):
    out = B.access_profile(_split_table(D.accesses(spark, sf_dir))[1])
    return out.select("actor", "event_count", "bytes_total", "bytes_max", us("bytes_max_time"), "error_count", *(F.array_join(c, ",").alias(c) for c in ("known_operations", "known_buckets", "known_ips")))


@register("SELECT actor, ip, epoch_us(min(event_time)) AS first_seen, epoch_us(max(event_time)) AS last_seen FROM cur GROUP BY actor, ip")
def ct_profile(spark, sf_dir):
    rows = B.api_profile(_current(spark, sf_dir)).select("actor", F.explode("ips").alias("e"))
    return rows.select("actor", "e.ip", us("e.first_seen").alias("first_seen"), us("e.last_seen").alias("last_seen"))


@register("SELECT actor, c.n AS api_events, a.n AS access_events, f.n AS flow_events, CAST(CASE WHEN c.n IS NULL AND a.n IS NULL THEN false ELSE c.s END AS INT) AS is_system FROM (SELECT actor, count(*) AS n, arg_min(is_system, (event_time, event_uid)) AS s FROM cur GROUP BY actor) c FULL JOIN (SELECT actor, count(*) AS n FROM acur GROUP BY actor) a USING (actor) FULL JOIN (SELECT eni AS actor, count(*) AS n FROM fcur GROUP BY eni) f USING (actor)")
def actor_profiles(spark, sf_dir):
    flow = B.flow_profile(_split_table(D.flows(spark, sf_dir))[1], ["eni"]).withColumnRenamed("eni", "actor")
    out = B.assemble_profiles(B.api_profile(_current(spark, sf_dir)), B.access_profile(_split_table(D.accesses(spark, sf_dir))[1]), flow)
    return out.select("actor", F.col("api.event_count").alias("api_events"), F.col("access.event_count").alias("access_events"), F.col("flow.event_count").alias("flow_events"), F.col("is_system").cast("int").alias("is_system"))


@register(f"SELECT * FROM (SELECT count(*) FILTER (NOT coalesce(s, false)) AS human_actors, count(*) FILTER (s) AS system_actors FROM (SELECT actor, CASE WHEN c.n IS NULL AND a.n IS NULL THEN false ELSE c.s END AS s FROM (SELECT actor, count(*) AS n, arg_min(is_system, (event_time, event_uid)) AS s FROM cur GROUP BY actor) c FULL JOIN (SELECT actor, count(*) AS n FROM acur GROUP BY actor) a USING (actor))) CROSS JOIN (SELECT count(a) AS resolved_interfaces, count(*) - count(a) AS unresolved_interfaces FROM (SELECT eni, max(a.actor) AS a FROM fcur LEFT JOIN {_ACTORS} a USING (src_ip) GROUP BY eni))")
def run_counters(spark, sf_dir):
    flows = _split_table(D.flows(spark, sf_dir))[1]
    none = B.flow_profile(flows.limit(0), ["eni"]).withColumnRenamed("eni", "actor")
    profiles = B.assemble_profiles(B.api_profile(_current(spark, sf_dir)), B.access_profile(_split_table(D.accesses(spark, sf_dir))[1]), none)
    return B.profile_counts(profiles, B.resolve_interfaces(flows, B.last_actor_by_ip(D.api_events(spark, sf_dir))))


def _spans(profile: DataFrame, by: str, columns: dict[str, str]) -> DataFrame:
    """The spans of a profile as rows (by, kind, value, first_seen, last_seen)."""
    def named(kind: str, column: str):
        return F.transform(column, lambda x: F.struct(F.lit(kind).alias("kind"), x[kind].cast("string").alias("value"), x["first_seen"].alias("first_seen"), x["last_seen"].alias("last_seen")))

    each = F.flatten(F.array(*(named(k, c) for k, c in columns.items())))
    return profile.select(by, F.explode(each).alias("e")).select(by, "e.kind", "e.value", us("e.first_seen").alias("first_seen"), us("e.last_seen").alias("last_seen"))


def _spans_sql(view: str, by: str, kinds: tuple[str, ...]) -> str:
    return " UNION ALL ".join(f"SELECT {by}, '{k}' AS kind, {k} AS value, epoch_us(min(event_time)) AS first_seen, epoch_us(max(event_time)) AS last_seen FROM {view} GROUP BY {by}, {k}" for k in kinds)


def _places(profile: DataFrame, by: str, key: str, column: str) -> DataFrame:
    """An ordered histogram as rows (by, place from 1, key, n)."""
    return profile.select(by, F.posexplode(column).alias("p", "e")).select(by, (F.col("p") + 1).alias("place"), F.col(f"e.{key}").alias(key), "e.n")


def _places_sql(view: str, by: str, key: str, value: str | None = None) -> str:
    return f"SELECT {by}, row_number() OVER (PARTITION BY {by} ORDER BY n DESC, {key}) AS place, {key}, n FROM (SELECT {by}, {value or key} AS {key}, count(*) AS n FROM {view} GROUP BY 1, 2)"


@register(_spans_sql("cur", "actor", ("ip", "uid_alt", "type")))
def ct_profile_spans(spark, sf_dir):
    return _spans(B.api_profile(_current(spark, sf_dir)), "actor", {"ip": "ips", "uid_alt": "uid_alts", "type": "types"})


@register(_places_sql("cur", "actor", "hour", "CAST(hour(event_time) AS INT)"))
def ct_profile_hours(spark, sf_dir):
    return _places(B.api_profile(_current(spark, sf_dir)), "actor", "hour", "hours")


@register("SELECT actor, count(*) AS event_count, arg_min(is_system, (event_time, event_uid)) AS is_system, arg_min(uid, (event_time, event_uid)) FILTER (uid IS NOT NULL) AS uid, string_agg(DISTINCT operation, ',' ORDER BY operation) AS known_operations, string_agg(DISTINCT region, ',' ORDER BY region) AS known_regions, string_agg(DISTINCT resource, ',' ORDER BY resource) AS known_resources FROM cur GROUP BY actor")
def ct_profile_identity(spark, sf_dir):
    return B.api_profile(_current(spark, sf_dir)).select("actor", "event_count", "is_system", "uid", *(F.array_join(c, ",").alias(c) for c in ("known_operations", "known_regions", "known_resources")))


@register(_spans_sql("acur", "actor", ("ip",)))
def s3_profile_spans(spark, sf_dir):
    return _spans(B.access_profile(_split_table(D.accesses(spark, sf_dir))[1]), "actor", {"ip": "ips"})


@register(_places_sql("acur", "actor", "code"))
def s3_profile_codes(spark, sf_dir):
    return _places(B.access_profile(_split_table(D.accesses(spark, sf_dir))[1]), "actor", "code", "response_codes")


def _flow_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.flow_profile(_split_table(D.flows(spark, sf_dir))[1], ["eni"])


@register(_spans_sql("fcur", "eni", ("dst_ip",)))
def vpc_profile_spans(spark, sf_dir):
    return _spans(_flow_profile(spark, sf_dir), "eni", {"dst_ip": "dst_spans"})


@register(_places_sql("fcur", "eni", "connection", "dst_ip || ':' || dst_port"))
def vpc_profile_connections(spark, sf_dir):
    return _places(_flow_profile(spark, sf_dir), "eni", "connection", "connections")


@register(_places_sql("fcur", "eni", "dst_port"))
def vpc_profile_ports(spark, sf_dir):
    return _places(_flow_profile(spark, sf_dir), "eni", "dst_port", "port_counts")


@register(_places_sql("fcur", "eni", "action"))
def vpc_profile_actions(spark, sf_dir):
    return _places(_flow_profile(spark, sf_dir), "eni", "action", "actions")


@register(f"""SELECT count(*) AS total_flows, count(*) FILTER (a IS NOT NULL) AS by_address, count(*) FILTER (a IS NULL AND e IS NOT NULL) AS by_interface, count(*) FILTER (a IS NULL AND e IS NULL AND eni IS NOT NULL) AS interface_alone,
  count(*) FILTER (a IS NULL AND eni IS NULL) AS skipped_flows FROM (SELECT f.eni, a.actor AS a, e.actor AS e FROM (SELECT CASE WHEN event_uid % 7 > 0 THEN eni END AS eni, CASE WHEN event_uid % 3 = 0 AND suppkey % 2 = 0 THEN src_ip ELSE 'none' END AS src_ip, event_time FROM fcur) f LEFT JOIN {_ACTORS} a USING (src_ip)
  LEFT JOIN (SELECT DISTINCT eni, 1 AS actor FROM fcur JOIN {_ACTORS} a USING (src_ip) WHERE event_uid % 7 > 0 AND event_uid % 3 = 0 AND suppkey % 2 = 0) e USING (eni))""")
def flow_counters(spark, sf_dir):
    rows = _split_table(D.flows(spark, sf_dir))[1]
    rows = rows.withColumns({"eni": F.when(F.col("event_uid") % 7 > 0, F.col("eni")), "src_ip": F.when((F.col("event_uid") % 3 == 0) & (F.col("suppkey") % 2 == 0), F.col("src_ip")).otherwise("none")})
    return B.flow_counts(rows, B.last_actor_by_ip(D.api_events(spark, sf_dir)))


@register(f"SELECT 'human' AS slice, actor FROM (SELECT actor, arg_min(is_system, (event_time, event_uid)) AS s FROM cur GROUP BY actor) FULL JOIN (SELECT DISTINCT actor FROM acur) USING (actor) WHERE NOT coalesce(s, false) UNION ALL SELECT 'system', actor FROM (SELECT actor, arg_min(is_system, (event_time, event_uid)) AS s FROM cur GROUP BY actor) WHERE s UNION ALL SELECT 'unresolved_interface', eni FROM fcur LEFT JOIN {_ACTORS} a USING (src_ip) GROUP BY eni HAVING max(a.actor) IS NULL")
def actor_slices(spark, sf_dir):
    flows = _split_table(D.flows(spark, sf_dir))[1]
    none = B.flow_profile(flows.where("false"), ["eni"]).withColumnRenamed("eni", "actor")
    profiles = B.assemble_profiles(B.api_profile(_current(spark, sf_dir)), B.access_profile(_split_table(D.accesses(spark, sf_dir))[1]), none)
    return B.actor_slices(profiles, B.resolve_interfaces(flows, B.last_actor_by_ip(D.api_events(spark, sf_dir))))


# Scores of actors.


@register(f"SELECT actor, event_uid, {_r(*fixed.CT_WEIGHTS)}, round(composite, 6) AS composite FROM comp")
def ueba_ct_event_dims(spark, sf_dir):
    return rounded(U.api_event_dimensions(_current(spark, sf_dir), _base(spark, sf_dir)).drop("event_time"))


def _day(frame: DataFrame) -> DataFrame:
    return frame.withColumn("day", F.to_date("event_time"))


def _api_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.api_daily_scores(_current(spark, sf_dir), _base(spark, sf_dir))


def _access_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = _split_table(D.accesses(spark, sf_dir))
    return U.access_scores(_day(after), before, ["actor", "day"])


def _flow_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = _split_table(D.flows(spark, sf_dir).withColumn("actor", F.col("eni")))
    return U.flow_scores(_day(after), before, ["actor", "day"])


def _texted(frame: DataFrame) -> DataFrame:
    return frame.withColumn("day", F.col("day").cast("string"))


def _texted_sql(view: str) -> str:
    return f"SELECT * REPLACE (CAST(day AS VARCHAR) AS day) FROM {view}"


@register(_texted_sql("cscore"))
def ueba_ct_score(spark, sf_dir):
    return _texted(_api_scores(spark, sf_dir))


@register(_texted_sql("ascore"))
def ueba_s3_score(spark, sf_dir):
    return _texted(_access_scores(spark, sf_dir))


@register(_texted_sql("fscore"))
def ueba_vpc_score(spark, sf_dir):
    return _texted(_flow_scores(spark, sf_dir))


def _final(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.combine_scores(_api_scores(spark, sf_dir), _access_scores(spark, sf_dir), _flow_scores(spark, sf_dir), ["actor", "day"])


@register(_texted_sql("final"))
def ueba_final(spark, sf_dir):
    return _texted(_final(spark, sf_dir)).withColumn("sources_used", F.array_join("sources_used", ","))


@register("SELECT actor, CAST(day AS VARCHAR) AS day, final_score FROM final WHERE NOT has_any_baseline")
def first_seen_entities(spark, sf_dir):
    return R.known_and_new(_texted(_final(spark, sf_dir)))[1].select("actor", "day", "final_score")


# Splits and fields.


def _sizes(parts: tuple[DataFrame, DataFrame]) -> DataFrame:
    before, after = parts
    count = lambda f, n: f.agg(F.count("*").alias("n")).withColumn("part", F.lit(n))
    return count(before, "baseline").unionByName(count(after, "current"))


def _split_sql(bound: str) -> str:
    return f"SELECT 'baseline' AS part, count(*) AS n FROM ev WHERE epoch_us(event_time) < {bound} UNION ALL SELECT 'current', count(*) FROM ev WHERE epoch_us(event_time) >= {bound}"


@register(_split_sql(f"epoch_us(TIMESTAMP '{D.CUTOFF}')"))
def split_cutoff(spark, sf_dir):
    return _sizes(E.split_at(D.api_events(spark, sf_dir), D.CUTOFF))


@register(_split_sql("(SELECT max(epoch_us(event_time)) - 7 * 86400000000 FROM ev)"))
def split_last_n_days(spark, sf_dir):
    return _sizes(E.split_last_days(D.api_events(spark, sf_dir), 7))


@register(_split_sql("(SELECT min(epoch_us(event_time)) + CAST(floor((max(epoch_us(event_time)) - min(epoch_us(event_time))) * 0.7) AS BIGINT) FROM ev)"))
def split_70pct(spark, sf_dir):
    return _sizes(E.split_share(D.api_events(spark, sf_dir)))


@register("""SELECT entity_key, entity_type, count(*) AS n FROM (SELECT CASE WHEN a AND p THEN 'principal:' || account || ':' || principal WHEN p THEN 'principal:unknown_account:' || principal WHEN a AND i THEN 'interface:' || account || ':' || iface
  WHEN a THEN 'host:' || account || ':' || ip WHEN i THEN 'interface:unknown_account:' || iface ELSE 'host:unknown_account:' || ip END AS entity_key, CASE WHEN p THEN 'principal' WHEN i THEN 'interface' ELSE 'host' END AS entity_type
  FROM (SELECT *, account <> 'unknown_account' AS a, principal <> 'null' AS p, iface <> ' ' AS i FROM (SELECT CASE WHEN l_linenumber % 3 = 0 THEN 'acct' || (l_suppkey % 3) ELSE 'unknown_account' END AS account,
  CASE WHEN l_linenumber % 2 = 0 THEN 'p' || l_suppkey ELSE 'null' END AS principal, CASE WHEN l_partkey % 2 = 0 THEN 'eni-' || l_suppkey ELSE ' ' END AS iface, 'ip_' || (l_suppkey % 40) AS ip FROM lineitem))) GROUP BY ALL""")
def entity_key(spark, sf_dir):
    rows = D.read(spark, sf_dir, "lineitem")
    text = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    supp = F.col("l_suppkey")
    account = F.when(F.col("l_linenumber") % 3 == 0, text("acct", supp % 3)).otherwise("unknown_account")
    principal = F.when(F.col("l_linenumber") % 2 == 0, text("p", supp)).otherwise("null")
    iface = F.when(F.col("l_partkey") % 2 == 0, text("eni-", supp)).otherwise(" ")
    who = N.entity(account, principal, F.lit("unknown_src_uid"), iface, text("ip_", supp % 40))
    return rows.select(who.alias("e")).groupBy("e.entity_key", "e.entity_type").agg(F.count("*").alias("n"))


@register("SELECT CASE WHEN dst_port = 1 THEN dst_ip ELSE dst_ip || ':' || dst_port END AS destination, count(*) AS n FROM fl GROUP BY 1")
def destination_key(spark, sf_dir):
    place = N.destination(F.lit(None).cast("string"), F.col("dst_ip"), F.when(F.col("dst_port") > 1, F.col("dst_port")))
    return D.flows(spark, sf_dir).groupBy(place.alias("destination")).agg(F.count("*").alias("n"))


@register("SELECT event_uid, epoch_us(event_time) // 1000000 AS seconds FROM ev")
def epoch_unit_parse(spark, sf_dir):
    micros = X.epoch_us("event_time")
    unit = F.col("event_uid") % 4
    value = F.when(unit == 0, micros.cast("string")).when(unit == 1, F.expr("unix_micros(event_time) div 1000").cast("string")).when(unit == 2, F.expr("unix_micros(event_time) div 1000000").cast("string")).otherwise(F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return D.api_events(spark, sf_dir).select("event_uid", F.unix_seconds(N.any_epoch(value)).alias("seconds"))


@register("SELECT coalesce(CASE WHEN event_uid % 3 = 0 THEN actor END, CASE WHEN event_uid % 3 = 1 THEN ip END, 'unknown_principal') AS principal, count(*) AS n FROM ev GROUP BY 1")
def coalesce_fields(spark, sf_dir):
    uid = F.col("event_uid") % 3
    rows = D.api_events(spark, sf_dir).select(F.struct(F.struct(F.when(uid == 0, F.col("actor")).alias("uid"), F.when(uid == 1, F.col("ip")).alias("name")).alias("user")).alias("actor"))
    return rows.groupBy(N.coalesce_paths(rows, fixed.FIELD_PATHS["principal"], "unknown_principal").alias("principal")).agg(F.count("*").alias("n"))


@register("SELECT CASE WHEN k % 3 = 0 THEN resource WHEN k % 3 = 1 THEN ip || '|' || region ELSE 'unknown' END AS label, count(*) AS n FROM ev GROUP BY 1")
def resource_label(spark, sf_dir):
    part = F.col("k") % 3
    item = lambda name, uid: F.struct(name.alias("name"), uid.alias("uid"), F.lit(None).cast("string").alias("type"))
    listed = F.when(part == 1, F.array(item(F.col("ip"), F.lit("x")), item(F.lit(""), F.col("region"))))
    return D.api_events(spark, sf_dir).groupBy(N.resource_label(F.when(part == 0, F.col("resource")), listed).alias("label")).agg(F.count("*").alias("n"))


# Exfiltration.


def _net_parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    before, after = _split_table(D.exfil_flows(spark, sf_dir))
    by_dest = after.withColumn("src_ip", F.lit("any"))  # an interface has one address here
    return before, E.with_rarity(by_dest, before)


@register("SELECT event_uid, rare_destination, rare_user_agent, rare_resource FROM net")
def rarity_flags(spark, sf_dir):
    return _net_parts(spark, sf_dir)[1].select("event_uid", "rare_destination", "rare_user_agent", "rare_resource")


@register(f"SELECT 'interface:acct:' || interface_uid AS entity_key, {_r('p95_bytes', 'p95_events')} FROM p95")
def entity_daily_p95(spark, sf_dir):
    return rounded(E.entity_daily_p95(_net_parts(spark, sf_dir)[0]))


_NET = ["interface_uid", "destination", "total_bytes_out", "event_count", "avg_bytes_out", "median_bytes_out", "max_bytes_out", "small_transfer_count", "rare_destination_event_count", "rare_user_agent_event_count", "distinct_user_agents", "duration_hours", "small_transfer_ratio", "rare_destination_ratio", "rare_user_agent_ratio"]


@register(f"SELECT * REPLACE ({_r('avg_bytes_out', 'median_bytes_out', 'duration_hours', 'small_transfer_ratio', 'rare_destination_ratio', 'rare_user_agent_ratio')}) FROM netf")
def network_features(spark, sf_dir):
    return rounded(E.network_features(_net_parts(spark, sf_dir)[1]).select(*_NET))


_TIMING = ["mean_interval_seconds", "std_interval_seconds", "median_interval_seconds", "min_interval_seconds", "max_interval_seconds", "interval_cv"]


@register(f"SELECT interface_uid, destination, interval_count, {_r(*_TIMING)} FROM timf")
def timing_features(spark, sf_dir):
    return rounded(E.timing_features(_net_parts(spark, sf_dir)[1]).select("interface_uid", "destination", "interval_count", *_TIMING))


@register(f"SELECT interface_uid, destination, {_r('interval_median_band_ratio')} FROM timf")
def interval_band_ratio(spark, sf_dir):
    return rounded(E.timing_features(_net_parts(spark, sf_dir)[1]).select("interface_uid", "destination", "interval_median_band_ratio"))


def _read_parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    before, after = E.split_at(D.exfil_reads(spark, sf_dir), D.CUTOFF)
    return before, E.with_rarity(after, before)


@register("SELECT principal, count(*) AS s3_event_count, count(*) AS get_object_count, count(DISTINCT resource) AS distinct_resources, count(*) FILTER (rare) AS rare_resource_event_count, round((max(epoch_us(event_time)) - min(epoch_us(event_time))) / 3.6e9, 6) AS s3_duration_hours FROM reads GROUP BY principal")
def s3_features(spark, sf_dir):
    out = E.store_features(_read_parts(spark, sf_dir)[1])
    return rounded(out.select("principal", "s3_event_count", "get_object_count", "distinct_resources", "rare_resource_event_count", "s3_duration_hours"))


def _network_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, marked = _net_parts(spark, sf_dir)
    return E.score_network(E.join_features(E.network_features(marked), E.timing_features(marked), E.store_features(marked)), E.entity_daily_p95(before))


@register("SELECT interface_uid, destination, network_risk_score FROM nets")
def network_score(spark, sf_dir):
    return _network_alerts(spark, sf_dir).select("interface_uid", "destination", "network_risk_score")


def _time_parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    before, marked = _read_parts(spark, sf_dir)
    return E.time_baseline(E.daily_reads(before.withColumn("rare_resource", F.lit(False)))), E.daily_reads(marked)


@register("SELECT principal, CAST(access_day AS VARCHAR) AS access_day, b AS daily_s3_read_bytes, n AS daily_s3_read_events, res AS daily_distinct_resources, rare_n AS daily_rare_resource_events FROM daily")
def daily_reads(spark, sf_dir):
    return _time_parts(spark, sf_dir)[1].select("principal", F.col("access_day").cast("string").alias("access_day"), "daily_s3_read_bytes", "daily_s3_read_events", "daily_distinct_resources", "daily_rare_resource_events")


_TBASE = ["baseline_avg_daily_bytes", "baseline_p95_daily_bytes", "baseline_std_daily_bytes", "baseline_avg_daily_events", "baseline_p95_daily_events"]


@register(f"SELECT principal, baseline_days, {_r(*_TBASE, places=4)}, baseline_total_bytes, baseline_total_events FROM tbase")
def time_baseline(spark, sf_dir):
    return rounded(_time_parts(spark, sf_dir)[0].drop("cloud_account", "entity_key", "entity_type"), 4)


def _ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, daily = _time_parts(spark, sf_dir)
    return E.activity_ratios(daily, before)


@register(f"SELECT principal, CAST(access_day AS VARCHAR) AS access_day, {_r('bytes_ratio', 'event_ratio', 'activity_ratio')} FROM act")
def activity_ratio(spark, sf_dir):
    return rounded(_ratios(spark, sf_dir).select("principal", F.col("access_day").cast("string").alias("access_day"), "bytes_ratio", "event_ratio", "activity_ratio"))


@register(f"SELECT principal, {_r('trend_slope_ratio_per_day')} FROM timef")
def trend_slope(spark, sf_dir):
    return rounded(E.time_features(_ratios(spark, sf_dir)).select("principal", "trend_slope_ratio_per_day"))


_TIMEF = ["baseline_days", "current_days", "elevated_days", "spike_days", "total_distinct_resource_day_count", "rare_resource_event_count", "total_current_bytes", "total_current_events", "duration_days"]
_TIMED = ["avg_activity_ratio", "max_activity_ratio", "early3_avg_ratio", "final3_avg_ratio", "expected_current_bytes", "expected_current_events"]


@register(f"SELECT principal, {', '.join(_TIMEF)}, {_r(*_TIMED, places=4)} FROM timef")
def time_features(spark, sf_dir):
    return rounded(E.time_features(_ratios(spark, sf_dir)).select("principal", *_TIMEF, *_TIMED), 4)


@register("SELECT principal, count(*) FILTER (x >= 2.5) AS elevated, coalesce(string_agg(CAST(access_day AS VARCHAR), '|' ORDER BY access_day) FILTER (x >= 2.5), '') AS elevated_day_dates, coalesce(string_agg(CAST(access_day AS VARCHAR), '|' ORDER BY access_day) FILTER (x >= 4), '') AS spike_day_dates, string_agg(CAST(access_day AS VARCHAR), '|' ORDER BY access_day) FILTER (l <= 3) AS final_window_days FROM act GROUP BY principal")
def time_evidence(spark, sf_dir):
    return E.time_features(_ratios(spark, sf_dir)).select("principal", F.col("elevated_days").alias("elevated"), "elevated_day_dates", "spike_day_dates", "final_window_days")


@register("SELECT principal, time_based_risk_score, time_detection_types FROM times")
def time_score(spark, sf_dir):
    return E.score_time(E.time_features(_ratios(spark, sf_dir))).select("principal", "time_based_risk_score", "time_detection_types")


_RANKED_DAYS = "SELECT a.*, t.final3_avg_ratio, row_number() OVER (PARTITION BY a.principal ORDER BY round(coalesce(activity_ratio, 0), 2) DESC, access_day) AS top FROM act a JOIN timef t USING (principal)"
_NAMED_DAYS = f"SELECT *, row_number() OVER (PARTITION BY principal ORDER BY access_day) AS place FROM ({_RANKED_DAYS}) WHERE x >= {fixed.SUSTAINED_RATIO} OR (final3_avg_ratio >= {fixed.RAMP_FINAL} AND l <= 3) OR top <= 3"


@register(f"""SELECT 'principal:acct:' || principal AS entity_key, CAST(access_day AS VARCHAR) AS date, round(coalesce(activity_ratio, 0), 2) AS activity_ratio, round(coalesce(bytes_ratio, 0), 2) AS bytes_ratio, round(coalesce(event_ratio, 0), 2) AS event_ratio,
  b AS bytes, CAST(trunc(baseline_avg_daily_bytes) AS BIGINT) AS expected_bytes, CAST(trunc(greatest(0.0, b - baseline_avg_daily_bytes)) AS BIGINT) AS excess_bytes, n AS events, round(baseline_avg_daily_events, 2) AS expected_events, res AS distinct_resources, rare_n AS rare_resource_events,
  concat_ws('|', CASE WHEN x >= {fixed.SUSTAINED_RATIO} THEN 'elevated' END, CASE WHEN x >= {fixed.SPIKE_RATIO} THEN 'spike' END, CASE WHEN rare_n > 0 THEN 'rare_resources' END) AS flags FROM ({_NAMED_DAYS}) WHERE place <= 10""")
def contributing_day_rows(spark, sf_dir):
    return R.contributing_days(E.score_time(E.time_features(_ratios(spark, sf_dir)))).withColumn("flags", F.array_join("flags", "|"))


@_same("contributing_day_rows")
def contributing_days(spark, sf_dir):
    return contributing_day_rows(spark, sf_dir)


def _alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _network_alerts(spark, sf_dir).unionByName(E.score_time(E.time_features(_ratios(spark, sf_dir))), allowMissingColumns=True)


@register("SELECT 'network' AS alert_family, 'interface:acct:' || interface_uid AS entity_key, destination, network_risk_score AS combined_risk_score FROM nets WHERE network_risk_score >= 20 UNION ALL SELECT 'time_based', 'principal:acct:' || principal, 's3_data_access_time_series', time_based_risk_score FROM times WHERE time_based_risk_score >= 20")
def alerts_union(spark, sf_dir):
    return _alerts(spark, sf_dir).where("combined_risk_score >= 20").select("alert_family", "entity_key", "destination", "combined_risk_score")


@register("SELECT 'network' AS alert_family, 'interface:acct:' || interface_uid AS entity_key, destination, network_risk_score AS combined_risk_score FROM nets UNION ALL SELECT 'time_based', 'principal:acct:' || principal, 's3_data_access_time_series', time_based_risk_score FROM times")
def ordered_alerts(spark, sf_dir):
    return E.ordered_alerts(_alerts(spark, sf_dir)).select("alert_family", "entity_key", "destination", "combined_risk_score")


_REASONS = [
    (f"event_count >= {fixed.MIN_EVENTS}", "'high repeated event count: ' || event_count"),
    (f"small_transfer_ratio >= {fixed.MIN_SMALL_RATIO}", "'mostly small transfers: ' || printf('%.2f', small_transfer_ratio)"),
    (f"duration_hours >= {fixed.MIN_HOURS}", "'spread over ' || printf('%.1f', duration_hours) || ' hours'"),
    (f"total_bytes_out >= {fixed.MIN_TOTAL_BYTES}", "'meaningful accumulated egress: ' || total_bytes_out || ' bytes'"),
    ("p95_bytes > 0 AND total_bytes_out > p95_bytes", "'bytes_out above entity daily p95 baseline: ' || CAST(trunc(p95_bytes) AS BIGINT)"),
    ("p95_events > 0 AND event_count > p95_events", "'event_count above entity daily p95 baseline: ' || CAST(trunc(p95_events) AS BIGINT)"),
    ("rare_destination_ratio >= 0.5", "'destination is new/rare for this entity'"), ("rare_user_agent_ratio >= 0.5", "'user agent is new/rare for this entity'"),
]


@register(f"SELECT interface_uid, destination, concat_ws('; ', {', '.join(f'CASE WHEN {c} THEN {t} END' for c, t in _REASONS)}) AS alert_reasons FROM nets n LEFT JOIN p95 p USING (interface_uid) LEFT JOIN timf t USING (interface_uid, destination) WHERE NOT coalesce(interval_count >= {fixed.MIN_INTERVALS} AND interval_cv <= {fixed.JITTERED_CV}, false)")
def alert_reasons(spark, sf_dir):
    regular = (F.col("interval_count") >= fixed.MIN_INTERVALS) & (F.col("interval_cv") <= fixed.JITTERED_CV)  # their texts round halves as Java does, and are tested on rows
    return _network_alerts(spark, sf_dir).where(~F.coalesce(regular, F.lit(False))).select("interface_uid", "destination", "alert_reasons")


# Findings.


def _daily_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texted(_api_scores(spark, sf_dir)).withColumnRenamed("score", "final_score")


_PEAK = "(SELECT actor, max(score) AS ueba_peak, arg_max(CAST(day AS VARCHAR), (score, -date_diff('day', DATE '2000-01-01', day))) AS peak_day FROM cscore WHERE score > 0 GROUP BY actor)"


@register(f"""SELECT *, CAST(ueba_peak >= 0.4 AS INT) + CAST(network_max >= 40 AS INT) + CAST(time_max >= 40 AS INT) + CAST(session_max >= 40 AS INT) AS signals FROM (
  SELECT actor, round(coalesce(ueba_peak, 0), 4) AS ueba_peak, peak_day, coalesce(network_max, 0) AS network_max, coalesce(time_max, 0) AS time_max, round(coalesce(session_max, 0), 4) AS session_max FROM {_PEAK} p
  FULL JOIN (SELECT interface_uid AS actor, max(network_risk_score) AS network_max, 0.0 AS time_max FROM nets GROUP BY 1 UNION ALL SELECT principal, 0.0, time_based_risk_score FROM times) x USING (actor)
  FULL JOIN (SELECT identity_id AS actor, max(session_risk_score) AS session_max FROM (SELECT * FROM risk ORDER BY session_risk_score DESC, session_id LIMIT {fixed.TOP_SESSIONS}) GROUP BY 1) s USING (actor))""")
def findings_matrix(spark, sf_dir):
    out = R.findings_matrix(_daily_scores(spark, sf_dir), R.alert_actor(_alerts(spark, sf_dir)), _scored(spark, sf_dir))
    return rounded(out.select("actor", "ueba_peak", "peak_day", "network_max", "time_max", "session_max", "signals"), 4)


_DAYS = [f"2024-01-{d}" for d in range(22, 31)]


@register("SELECT actor, " + ", ".join(f"max(score) FILTER (day = DATE '{d}') AS \"{d}\"" for d in _DAYS) + ", max(score) AS peak FROM cscore GROUP BY actor")
def score_trend(spark, sf_dir):
    return R.score_trend(_daily_scores(spark, sf_dir), _DAYS)


@register(f"SELECT actor, ueba_peak, peak_day FROM {_PEAK}")
def peak_day(spark, sf_dir):
    return R.peak_scores(_daily_scores(spark, sf_dir))


@register(f"SELECT actor, peak_day, 'cloudtrail' AS source, dimension, value FROM (UNPIVOT (SELECT c.actor, p.peak_day, {', '.join(f'CAST(c.{d} AS DOUBLE) AS {d}' for d in fixed.CT_WEIGHTS)} FROM cscore c JOIN {_PEAK} p ON p.actor = c.actor AND CAST(c.day AS VARCHAR) = p.peak_day) ON {', '.join(fixed.CT_WEIGHTS)} INTO NAME dimension VALUE value) WHERE value > 0")
def peak_day_signals(spark, sf_dir):
    scores = _daily_scores(spark, sf_dir)
    return R.peak_day_signals(scores, {"cloudtrail": scores.select("actor", "day", *fixed.CT_WEIGHTS)})


def _items(view: str, extra: str) -> str:
    return " UNION ALL ".join(f"SELECT actor, '{k}' AS kind, {k} AS item{extra} FROM {view}" for k in ("operation", "resource"))


@register(f"SELECT actor, kind, item, CAST(min(day) AS VARCHAR) AS first_day FROM ({_items('cur', ', CAST(event_time AS DATE) AS day')}) i WHERE actor IN (SELECT actor FROM base) AND NOT EXISTS (SELECT 1 FROM ({_items('base', '')}) b WHERE b.actor = i.actor AND b.kind = i.kind AND b.item = i.item) GROUP BY actor, kind, item")
def period_anomalies(spark, sf_dir):
    long = lambda f: f.select("actor", F.to_date("event_time").cast("string").alias("day"), F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("item")) for k in ("operation", "resource")))).alias("p")).select("actor", "day", "p.kind", "p.item")
    return R.period_anomalies(long(_current(spark, sf_dir)), long(_base(spark, sf_dir)).select("actor", "kind", "item").distinct())


@register("SELECT actor, CAST(sum(na) AS BIGINT) AS network_alerts, CAST(sum(d) AS BIGINT) AS destinations, max(nm) AS network_max, max(tm) AS time_max FROM (SELECT interface_uid AS actor, count(*) AS na, count(DISTINCT destination) AS d, max(network_risk_score) AS nm, 0.0 AS tm FROM nets GROUP BY 1 UNION ALL SELECT principal, 0, 0, 0.0, time_based_risk_score FROM times) GROUP BY actor")
def exfil_by_actor(spark, sf_dir):
    return R.exfil_by_actor(R.alert_actor(_alerts(spark, sf_dir))).drop("best_time_entity")


_DAILY = f"SELECT eni, CAST(event_time AS DATE) AS day, min(a.actor) AS actor FROM fcur JOIN {_ACTORS} a USING (src_ip) WHERE suppkey % 3 > 0 GROUP BY 1, 2"


@register(f"SELECT interface_uid, destination, coalesce(e.actor, interface_uid) AS actor FROM nets LEFT JOIN (SELECT eni, arg_max(actor, day) AS actor FROM ({_DAILY}) GROUP BY eni) e ON e.eni = interface_uid")
def alert_actor_names(spark, sf_dir):
    flows = _split_table(D.flows(spark, sf_dir))[1].where(F.col("suppkey") % 3 > 0)
    daily = _day(flows).join(B.last_actor_by_ip(D.api_events(spark, sf_dir)), "src_ip").select("day", "eni", "actor")
    return R.alert_actor(_network_alerts(spark, sf_dir), R.latest_interfaces(daily)).select("interface_uid", "destination", "actor")


@register("SELECT actor, alert_family, place, entity_key, destination, score FROM (SELECT interface_uid AS actor, 'network' AS alert_family, row_number() OVER (PARTITION BY interface_uid ORDER BY network_risk_score DESC, destination) AS place, 'interface:acct:' || interface_uid AS entity_key, destination, network_risk_score AS score FROM nets UNION ALL SELECT principal, 'time_based', row_number() OVER (PARTITION BY principal ORDER BY time_based_risk_score DESC), 'principal:acct:' || principal, 's3_data_access_time_series', time_based_risk_score FROM times)")
def exfil_actor_rows(spark, sf_dir):
    alerts, columns = R.alert_actor(_alerts(spark, sf_dir)), ("actor", "alert_family", "place", "entity_key", "destination")
    network = R.ranked_alerts(alerts, "network_risk_score", "network").select(*columns, F.col("network_risk_score").alias("score"))
    return network.unionByName(R.ranked_alerts(alerts, "time_based_risk_score", "time_based", keep=1).select(*columns, F.col("time_based_risk_score").alias("score")))


def _evidence_sql(today: str, before: str, by: str, kinds: dict[str, str]) -> str:
    long = lambda v: " UNION ALL ".join(f"SELECT {by} AS actor, '{k}' AS kind, CAST({c} AS VARCHAR) AS value, event_time FROM {v}" for k, c in kinds.items())
    return f"SELECT actor, kind, value, count(*) AS n, epoch_us(min(event_time)) AS first_seen FROM ({long(today)}) t WHERE NOT EXISTS (SELECT 1 FROM ({long(before)}) b WHERE b.actor = t.actor AND b.kind = t.kind AND b.value = t.value) GROUP BY ALL"


@register(_evidence_sql("cur", "base", "actor", {k: k for k in ("operation", "ip", "region", "resource")}))
def evidence_api(spark, sf_dir):
    return R.evidence_rows(R.api_evidence(_current(spark, sf_dir)), R.api_evidence(_base(spark, sf_dir))).withColumn("first_seen", us("first_seen"))


@register(_evidence_sql("acur", "abase", "actor", {k: k for k in ("operation", "ip", "bucket")}))
def evidence_access(spark, sf_dir):
    before, after = _split_table(D.accesses(spark, sf_dir))
    return R.evidence_rows(R.access_evidence(after), R.access_evidence(before)).withColumn("first_seen", us("first_seen"))


@register(_evidence_sql("fcur", "fbase", "eni", {"dst_ip": "dst_ip", "connection": "dst_ip || ':' || dst_port", "protocol": "protocol"}))
def evidence_flow(spark, sf_dir):
    before, after = _split_table(D.flows(spark, sf_dir).withColumn("actor", F.col("eni")))
    return R.evidence_rows(R.flow_evidence(after), R.flow_evidence(before)).withColumn("first_seen", us("first_seen"))


@register("SELECT actor, c AS \"column\", string_agg(item, ',' ORDER BY item) AS items FROM (" + " UNION ALL ".join(f"SELECT DISTINCT actor, 'known_{k}s' AS c, {k} AS item FROM cur s WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.actor = s.actor AND b.{k} = s.{k})" for k in ("region", "resource")) + ") GROUP BY ALL")
def evidence_new_vs_baseline(spark, sf_dir):
    out = R.new_evidence(B.api_profile(_current(spark, sf_dir)), B.api_profile(_base(spark, sf_dir)), ["known_regions", "known_resources"])
    return out.withColumn("items", F.array_join("items", ","))


@register("SELECT actor, CAST(hour AS INT) AS hour, CASE WHEN b IS NOT NULL AND n IS NOT NULL THEN 'both' WHEN n IS NOT NULL THEN 'incident' WHEN b IS NOT NULL THEN 'baseline' ELSE 'inactive' END AS state FROM (SELECT DISTINCT actor FROM ev) CROSS JOIN range(24) h(hour) LEFT JOIN (SELECT DISTINCT actor, hour(event_time) AS hour, 1 AS b FROM base) USING (actor, hour) LEFT JOIN (SELECT DISTINCT actor, hour(event_time) AS hour, 1 AS n FROM cur) USING (actor, hour)")
def hour_grid(spark, sf_dir):
    hours = lambda f: f.select("actor", F.hour("event_time").alias("hour"))
    return R.hour_grid(hours(_base(spark, sf_dir)), hours(_current(spark, sf_dir)))


@register("SELECT actor, CAST(day AS VARCHAR) AS day, round(m, 4) AS multiplier, round(z, 4) AS z_score, CASE WHEN m >= 3 OR z >= 2 THEN 'red' WHEN m >= 1.5 OR z >= 1 THEN 'amber' ELSE 'green' END AS level FROM (SELECT c.actor, c.day, c.n / d.mean AS m, CASE WHEN d.std > 0 THEN (c.n - d.mean) / d.std ELSE 0 END AS z FROM (SELECT actor, CAST(event_time AS DATE) AS day, count(*) AS n FROM cur GROUP BY ALL) c JOIN dslots d USING (actor))")
def volume_comparison(spark, sf_dir):
    days = _current(spark, sf_dir).groupBy("actor", F.to_date("event_time").cast("string").alias("day")).agg(F.count("*").alias("n"))
    rows = days.join(B.slot_stats(_base(spark, sf_dir), "day"), "actor")
    return rounded(rows.select("actor", "day", *(c.alias(n) for n, c in R.volume_comparison(F.col("n"), F.col("mean"), F.col("std")).items())), 4)


@register("SELECT actor, CASE WHEN coalesce(bool_or(is_system), false) THEN 'SYSTEM' WHEN actor LIKE 'eni-%' THEN 'ENI' WHEN NOT bool_or(has_any_baseline) THEN 'NEW' ELSE 'HUMAN' END AS tag FROM final LEFT JOIN (SELECT actor, arg_min(is_system, (event_time, event_uid)) AS is_system FROM cur GROUP BY actor) USING (actor) GROUP BY actor")
def actor_tags(spark, sf_dir):
    system = B.api_profile(_current(spark, sf_dir)).select("actor", "is_system")
    actors = _final(spark, sf_dir).groupBy("actor").agg(F.bool_or("has_any_baseline").alias("known")).join(system, "actor", "left")
    return actors.select("actor", R.actor_tag(F.col("is_system"), F.col("actor").startswith("eni-"), F.col("known")).alias("tag"))


@register("SELECT CASE WHEN final_score >= 0.7 THEN 'high' WHEN final_score >= 0.4 THEN 'elevated' WHEN final_score >= 0.2 THEN 'guarded' ELSE 'low' END AS band, count(*) AS n FROM final GROUP BY 1")
def score_bands(spark, sf_dir):
    return _final(spark, sf_dir).groupBy(R.score_band(F.col("final_score")).alias("band")).agg(F.count("*").alias("n"))


@register("SELECT label, count(*) AS n, count(*) FILTER (s BETWEEN 0.2 AND 1) AS in_range, count(*) FILTER (s >= 0.3 AND e) AS tp, count(*) FILTER (s >= 0.3 AND NOT e) AS fp, count(*) FILTER (s < 0.3 AND e) AS fn FROM (SELECT 'q' || (user_id % 3) AS label, user_id % 3 = 0 AS e, coalesce(ueba_peak, 0) AS s FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN " + _PEAK + " p ON p.actor = 'u' || u.user_id) GROUP BY label")
def detector_eval(spark, sf_dir):
    ids = D.read(spark, sf_dir, "events").select("user_id").distinct()
    truth = ids.select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("actor"), F.concat(F.lit("q"), (F.col("user_id") % 3).cast("string")).alias("label"), F.lit(0.2).alias("low"), F.lit(1.0).alias("high"),
        (F.col("user_id") % 3 == 0).alias("expected"), F.lit(0.3).alias("threshold"),
    )
    return R.detector_evaluation(R.peak_scores(_daily_scores(spark, sf_dir)), truth, "ueba_peak")


@register("SELECT operation, count(*) FILTER (c > 0.5 AND failed) AS tp, count(*) FILTER (c > 0.5 AND NOT failed) AS fp, count(*) FILTER (c <= 0.5 AND failed) AS fn, count(*) FILTER (c <= 0.5 AND NOT failed) AS tn FROM (SELECT operation, failed, composite AS c FROM comp JOIN cur USING (event_uid)) GROUP BY operation")
def anomaly_confusion(spark, sf_dir):
    rows = U.api_event_dimensions(_current(spark, sf_dir), _base(spark, sf_dir)).select("event_uid", "composite").join(_current(spark, sf_dir).select("event_uid", "operation", "failed"), "event_uid")
    return R.confusion(rows, F.col("composite") > 0.5, F.col("failed"), ["operation"])


@register("SELECT actor, count(*) AS n, epoch_us(min(event_time)) AS first_seen, epoch_us(max(event_time)) AS last_seen FROM (SELECT actor, event_time FROM ev UNION ALL SELECT actor, event_time FROM ac) GROUP BY actor")
def actor_timeline(spark, sf_dir):
    both = D.api_events(spark, sf_dir).select("actor", "event_time").unionByName(D.accesses(spark, sf_dir).select("actor", "event_time"))
    return N.actor_timeline(both, F.col("actor")).select("actor", "n", us("first_seen"), us("last_seen"))


# Raw text.

_LINE = "'2 123456789012 eni-' || printf('%x', l_suppkey) || ' 10.0.0.' || (l_suppkey % 250) || ' 10.1.1.' || (l_partkey % 250) || ' ' || (1000 + l_linenumber) || ' 443 6 ' || CAST(l_quantity AS BIGINT) || ' ' || CAST(round(l_extendedprice * 100) AS BIGINT) || ' ' || (1500000000 + l_orderkey) || ' ' || (1500000060 + l_orderkey) || ' ' || CASE l_returnflag WHEN 'R' THEN 'REJECT' ELSE 'ACCEPT' END || ' OK'"


@register(f"SELECT DISTINCT {', '.join(f'split_part(line, chr(32), {i})' + f' AS {n}' for i, n in enumerate(('version', 'account_id', 'interface_id', 'srcaddr', 'dstaddr', 'srcport', 'dstport', 'protocol', 'packets', 'bytes', 'start', 'end_', 'action', 'log_status'), 1))} FROM (SELECT {_LINE} AS line FROM lineitem)")
def flow_line_parse(spark, sf_dir):
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    c = F.col
    line = text(
        "2 123456789012 eni-", F.lower(F.hex("l_suppkey")), " 10.0.0.", c("l_suppkey") % 250, " 10.1.1.", c("l_partkey") % 250, " ", c("l_linenumber") + 1000, " 443 6 ", c("l_quantity").cast("long"), " ",
        F.round(c("l_extendedprice") * 100).cast("long"), " ", c("l_orderkey") + 1500000000, " ", c("l_orderkey") + 1500000060, " ", F.when(c("l_returnflag") == "R", "REJECT").otherwise("ACCEPT"), " OK",
    )
    texts = D.read(spark, sf_dir, "lineitem").select(text("sourcetype::aws:cloudwatchlogs:vpcflow before ", line, " after").alias("value"))
    return logs.flow_lines(texts).withColumnRenamed("end", "end_")


@register("SELECT CASE WHEN event_id % 3 = 0 THEN 'cloudtrail' WHEN event_id % 3 = 1 THEN 'guardduty' ELSE 'none' END AS shape, count(*) AS n FROM events GROUP BY 1")
def record_shape(spark, sf_dir):
    part, kind = F.col("event_id") % 3, F.col("event_type")
    text = F.when(part == 0, F.to_json(F.struct(F.lit("1").alias("eventVersion"), kind.alias("eventSource"), F.col("props").alias("eventName")))).when(
        part == 1, F.to_json(F.struct(F.lit("2").alias("schemaVersion"), kind.alias("type"), F.lit("a").alias("accountId"), F.lit("r").alias("region")))
    ).otherwise(F.col("props"))
    return D.read(spark, sf_dir, "events").groupBy(F.coalesce(logs.record_shape(text), F.lit("none")).alias("shape")).agg(F.count("*").alias("n"))


@register("SELECT DISTINCT event_type, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events")
def exact_dedup(spark, sf_dir):
    text = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"t":"'), "event_type", F.lit('","p":'), "props", F.lit("}"))).otherwise(F.concat(F.lit('{"p":'), "props", F.lit(',"t":"'), "event_type", F.lit('"}')))
    rows = D.read(spark, sf_dir, "events").select(F.from_json(text, "t string, p struct<k:long>").alias("r")).select(F.col("r.t").alias("event_type"), "r.p.k")
    return logs.exact_dedup(rows)


@register("SELECT event_type, count(*) AS total, count(*) FILTER (value IS NOT NULL AND event_id % 7 <> 0) AS valid FROM events GROUP BY event_type")
def conformance_counts(spark, sf_dir):
    rows = D.read(spark, sf_dir, "events").select("event_type", F.struct(F.col("value").alias("value"), F.when(F.col("event_id") % 7 != 0, F.col("event_id")).alias("uid")).alias("metadata"))
    return N.conformance(rows, ["metadata.uid", "metadata.value"], ["event_type"]).select("event_type", "total", "valid")


@register("""SELECT event_type, count(*) AS total, count(*) FILTER (e = '') AS valid, coalesce(string_agg(e, '; ' ORDER BY r) FILTER (e <> '' AND r <= 5), '') AS errors FROM (SELECT *, row_number() OVER (PARTITION BY event_type, e <> '' ORDER BY event_id) AS r FROM (SELECT event_type, event_id,
  concat_ws(', ', CASE WHEN event_id % 7 = 0 THEN 'metadata.uid: missing' END, CASE WHEN event_id % 11 = 0 THEN 'metadata.value: no double' END) AS e FROM events)) GROUP BY event_type""")
def conformance_errors(spark, sf_dir):
    value = F.when(F.col("event_id") % 11 == 0, F.lit("many")).otherwise(F.coalesce(F.col("value"), F.lit(0.0)).cast("string"))
    rows = D.read(spark, sf_dir, "events").select("event_type", "event_id", F.struct(value.alias("value"), F.when(F.col("event_id") % 7 != 0, F.col("event_id")).alias("uid")).alias("metadata"))
    return N.conformance(rows, ["metadata.uid", "metadata.value"], ["event_type"], {"metadata.value": "double"}, ["event_id"]).withColumn("errors", F.array_join("errors", "; "))


@register("SELECT event_type AS source, count(*) AS read, count(*) FILTER (event_id % 13 <> 0) AS mapped, count(*) FILTER (event_id % 13 = 0) AS skipped FROM events GROUP BY event_type")
def mapped_counts(spark, sf_dir):
    time = F.when(F.col("event_id") % 13 == 0, F.lit("yesterday")).otherwise(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    records = D.read(spark, sf_dir, "events").select(F.col("event_type").alias("source"), time.alias("eventTime"))
    return N.map_counts(records, records.withColumn("time", N.iso_millis(F.col("eventTime"))), "source")


@register("WITH t AS (SELECT user_id % 5 AS bucket, event_type AS name, count(*) AS n FROM events GROUP BY ALL) SELECT CAST(bucket AS VARCHAR) AS bucket, name, n FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY n DESC, name) AS r FROM t) WHERE r <= 3 UNION ALL SELECT NULL, name, CAST(sum(n) AS BIGINT) FROM t GROUP BY name")
def source_type_inventory(spark, sf_dir):
    texts = D.read(spark, sf_dir, "events").select((F.col("user_id") % 5).cast("string").alias("bucket"), F.concat(F.lit("x sourcetype::"), "event_type", F.lit(" y")).alias("value"))
    return logs.source_inventory(texts, "value", "bucket", keep=3)


# Raw records to events.


@register("SELECT event_id, epoch_ms(date_trunc('second', ts)) AS millis FROM events")
def iso_time_parse(spark, sf_dir):
    text = F.when(F.col("event_id") >= 0, F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return D.read(spark, sf_dir, "events").select("event_id", N.iso_millis(text).alias("millis"))


@register("SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN epoch_ms(date_trunc('second', ts)) END AS millis FROM events")
def access_time_parse(spark, sf_dir):
    text = F.when(F.col("event_id") % 5 == 0, F.lit("yesterday")).otherwise(F.date_format(F.col("ts").cast("timestamp"), "dd/MMM/yyyy:HH:mm:ss '+0000'"))
    return D.read(spark, sf_dir, "events").select("event_id", N.access_log_millis(text).alias("millis"))


@register("SELECT CASE l_linenumber % 4 WHEN 0 THEN 'ip' WHEN 1 THEN 'name' WHEN 2 THEN 'ip' ELSE 'instance' END AS kind, count(*) AS n FROM lineitem GROUP BY 1")
def address_kinds(spark, sf_dir):
    supp = F.col("l_suppkey").cast("string")
    text = F.when(F.col("l_linenumber") % 4 == 0, F.concat(F.lit("10.0.0."), supp)).when(F.col("l_linenumber") % 4 == 1, F.concat(F.lit("svc"), supp, F.lit(".amazonaws.com"))).when(
        F.col("l_linenumber") % 4 == 2, F.concat(F.lit("fe80::"), supp)
    ).otherwise(F.concat(F.lit("i-"), F.lpad(F.lower(F.hex("l_suppkey")), 8, "0")))
    # Suppliers beyond 999 would not make an address of three digits.
    kind = F.when(X.is_ip(F.regexp_replace(text, r"^(10\.0\.0\.)\d*?(\d{1,3})$", "$1$2")), "ip").when(X.is_instance_id(text), "instance").otherwise("name")
    return D.read(spark, sf_dir, "lineitem").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def _flow_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, text = F.col, lambda x: x.cast("string")
    return D.read(spark, sf_dir, "lineitem").select(
        F.lit("2").alias("version"), F.lit("1").alias("account_id"), F.concat(F.lit("eni-"), text(c("l_suppkey"))).alias("interface_id"), F.lit("10.0.0.1").alias("srcaddr"), F.lit("10.0.0.2").alias("dstaddr"),
        F.when(c("l_linenumber") == 1, "-").otherwise(text(c("l_linenumber"))).alias("srcport"), F.lit("443").alias("dstport"), F.lit("6").alias("protocol"), text(c("l_quantity").cast("long")).alias("packets"),
        text(F.round(c("l_extendedprice") * 100).cast("long")).alias("bytes"), F.when(c("l_linenumber") == 2, "0").otherwise(text(F.unix_seconds(c("l_shipdate").cast("timestamp")))).alias("start"),
        text(F.unix_seconds(c("l_shipdate").cast("timestamp")) + 60).alias("end"), F.when(c("l_returnflag") == "R", "REJECT").otherwise("ACCEPT").alias("action"), F.lit("OK").alias("log_status"),
    )


@register("SELECT interface_uid, port, status_id, class_uid, type_uid, count(*) AS n, count(time) AS timed, CAST(sum(time) AS BIGINT) AS times, CAST(sum(bytes) AS BIGINT) AS bytes FROM (SELECT 'eni-' || l_suppkey AS interface_uid, CASE WHEN l_linenumber <> 1 THEN l_linenumber END AS port, CASE WHEN l_returnflag = 'R' THEN 2 ELSE 1 END AS status_id, 4001 AS class_uid, 400106 AS type_uid, CASE WHEN l_linenumber <> 2 THEN epoch_ms(l_shipdate) END AS time, CAST(round(l_extendedprice * 100) AS BIGINT) AS bytes FROM lineitem) GROUP BY ALL")
def map_flow_events(spark, sf_dir):
    out = N.map_flow(_flow_records(spark, sf_dir))
    return out.groupBy("src_endpoint.interface_uid", "src_endpoint.port", "status_id", "class_uid", "type_uid").agg(F.count("*").alias("n"), F.count("time").alias("timed"), F.sum("time").alias("times"), F.sum("traffic.bytes").alias("bytes"))


@register("""SELECT name, is_system, activity_id, status_id, http_method, path, code, count(*) AS n FROM (SELECT CASE o_orderkey % 3 WHEN 0 THEN 's3-log-delivery' WHEN 1 THEN 'user' || (o_custkey % 5) ELSE NULL END AS name, o_orderkey % 3 = 0 AS is_system,
  CASE o_orderkey % 2 WHEN 0 THEN 2 ELSE 1 END AS activity_id, CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 1 END AS status_id, CASE o_orderkey % 2 WHEN 0 THEN 'GET' ELSE 'PUT' END AS http_method, '/k' || (o_custkey % 3) AS path,
  CASE WHEN o_orderstatus = 'F' THEN 403 ELSE 200 END AS code FROM orders) GROUP BY ALL""")
def map_access_events(spark, sf_dir):
    c, part, even = F.col, F.col("o_orderkey") % 3, F.col("o_orderkey") % 2 == 0
    text = lambda prefix, x: F.concat(F.lit(prefix), x.cast("string"))
    fields = {n: F.lit("-") for n in N.ACCESS_FIELDS} | {
        "bucket": c("o_orderpriority"), "timestamp": F.date_format(c("o_orderdate").cast("timestamp"), "dd/MMM/yyyy:HH:mm:ss '+0000'"), "requester": F.when(part == 1, text("arn:aws:iam::1:user/user", c("o_custkey") % 5)).otherwise("ab12"),
        "user_agent": F.when(part == 0, "aws-internal/3").otherwise("cli"), "operation": F.when(even, "REST.GET.OBJECT").otherwise("REST.PUT.OBJECT"), "http_status": F.when(c("o_orderstatus") == "F", "403").otherwise("200"),
        "request_uri": F.concat(F.when(even, "GET").otherwise("PUT"), F.lit(" "), text("/k", c("o_custkey") % 3), F.lit(" HTTP/1.1")),
    }
    out = N.map_access(D.read(spark, sf_dir, "orders").select(*(x.alias(n) for n, x in fields.items())))
    return out.groupBy(
        F.col("actor.user.name").alias("name"), F.col("unmapped.is_system_actor").alias("is_system"), "activity_id", "status_id", F.col("http_request.http_method").alias("http_method"), F.col("http_request.url.path").alias("path"), F.col("api.response.code").alias("code")
    ).agg(F.count("*").alias("n"))


@register("""SELECT name, is_system, activity_id, status_id, resources, count(*) AS n FROM (SELECT CASE event_uid % 5 WHEN 0 THEN actor WHEN 1 THEN 'role' || (k % 3) WHEN 2 THEN 'AWSServiceRoleFor' || (k % 2) WHEN 3 THEN 'AWSService' ELSE 'web' END AS name,
  event_uid % 5 IN (2, 3, 4) AS is_system, CASE WHEN operation IS NULL OR operation = '' THEN 0 """ + _CRUD + """ ELSE 99 END AS activity_id, CASE WHEN failed THEN 2 ELSE 1 END AS status_id, resource || ',r' || (k % 4) AS resources FROM ev) GROUP BY ALL""")
def map_audit_events(spark, sf_dir):
    part, k = F.col("event_uid") % 5, F.col("k").cast("string")
    no = F.lit(None).cast("string")
    text = lambda prefix, x: F.concat(F.lit(prefix), x.cast("string"))
    issuer = F.struct(F.when(part == 2, text("AWSServiceRoleFor", F.col("k") % 2)).alias("userName"), F.when(part == 1, text("arn:aws:iam::1:role/path/role", F.col("k") % 3)).alias("arn"))
    who = F.struct(
        F.when(part == 0, "IAMUser").when(part == 3, "AWSService").otherwise("AssumedRole").alias("type"), F.when(part == 0, F.col("actor")).alias("userName"), no.alias("principalId"),
        F.when(part == 4, F.lit("arn:aws:sts::1:assumed-role/web/i-0123456789abcdef0")).otherwise(F.lit("arn:aws:sts::1:assumed-role/x/session")).alias("arn"), no.alias("accountId"), no.alias("accessKeyId"),
        F.struct(issuer.alias("sessionIssuer")).alias("sessionContext"),
    )
    request = F.to_json(F.struct(F.col("resource").alias("bucketName"), text("arn:aws:iam::1:role/r", F.col("k") % 4).alias("roleArn"), F.struct(F.array(F.struct(F.col("resource").alias("resourceId"))).alias("items")).alias("resourcesSet")))
    names = [x.split()[0] for x in N.AUDIT_SCHEMA.split("userIdentity")[0].split(", ") if x.strip()]
    fields = {n: no for n in names} | {"eventTime": F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss'Z'"), "eventName": F.col("operation"), "errorCode": F.when(F.col("failed"), F.lit("Denied")), "userIdentity": who, "requestParameters": request, "responseElements": no, "additionalEventData": no}
    out = N.map_audit(D.api_events(spark, sf_dir).select(*(x.alias(n) for n, x in fields.items())))
    return out.groupBy(
        F.col("actor.user.name").alias("name"), F.col("unmapped.is_system_actor").alias("is_system"), "activity_id", "status_id", F.array_join("resources.name", ",").alias("resources")
    ).agg(F.count("*").alias("n"))


@register("SELECT CASE WHEN event_uid % 2 = 0 THEN 'sess' || (k % 9) ELSE actor END AS identity_id, CASE WHEN k % 7 = 0 THEN 'GetObject' ELSE operation END AS event_name, failed AS is_failed, count(*) AS n FROM ev GROUP BY ALL")
def session_normalize(spark, sf_dir):
    part = F.col("event_uid") % 2 == 0
    rows = D.api_events(spark, sf_dir).select(
        F.lit(6003).alias("class_uid"), F.unix_millis("event_time").alias("time"), F.when(F.col("failed"), 2).otherwise(1).alias("status_id"),
        F.struct(F.struct(F.col("actor").alias("name"), F.when(part, F.concat(F.lit("arn:aws:sts::1:assumed-role/r/sess"), (F.col("k") % 9).cast("string"))).otherwise(F.lit("AKIA")).alias("uid_alt"), F.lit(None).cast("string").alias("uid")).alias("user")).alias("actor"),
        F.struct(F.when(F.col("k") % 7 == 0, "REST.GET.OBJECT").otherwise(F.col("operation")).alias("operation")).alias("api"),
    )
    return N.normalize_sessions(rows).groupBy("identity_id", "event_name", "is_failed").agg(F.count("*").alias("n"))


@register("""SELECT entity_key, destination, count(*) AS n, CAST(sum(bytes) AS DOUBLE) AS bytes_out, min(epoch_us(event_time)) AS first_seen FROM (SELECT *, CASE WHEN event_uid % 2 = 0 THEN 'principal:77:n' || (suppkey % 7) ELSE 'interface:77:' || eni END AS entity_key,
  CASE WHEN dst_port = 1 THEN dst_ip ELSE dst_ip || ':' || dst_port END AS destination FROM fl) GROUP BY ALL""")
def exfil_normalize(spark, sf_dir):
    c = F.col
    rows = D.flows(spark, sf_dir).select(
        F.when(c("dst_port") % 2 == 0, F.unix_millis("event_time")).otherwise(F.unix_seconds("event_time")).alias("time"), F.struct(F.struct(F.lit("77").alias("uid")).alias("account")).alias("cloud"),
        F.struct(F.struct(F.when(c("event_uid") % 2 == 0, F.concat(F.lit("n"), (c("suppkey") % 7).cast("string"))).alias("name"), F.lit(None).cast("string").alias("uid")).alias("user")).alias("actor"),
        F.struct(c("src_ip").alias("ip"), c("eni").alias("interface_uid")).alias("src_endpoint"), F.struct(c("dst_ip").alias("ip"), F.when(c("dst_port") > 1, c("dst_port")).alias("port")).alias("dst_endpoint"),
        F.struct(c("bytes")).alias("traffic"),
    )
    return N.exfil_events(rows).groupBy("entity_key", "destination").agg(F.count("*").alias("n"), F.sum("bytes_out").alias("bytes_out"), F.min(X.epoch_us("event_time")).alias("first_seen"))


@register("SELECT operation, regexp_matches(lower(operation), 'getobject|listbucket|get.object|get.bucket|rest.get') AS store_event, service LIKE '%s3%' AND regexp_matches(lower(operation), 'getobject|get.object|download|read') AS store_read, count(*) AS n FROM (SELECT operation, CASE WHEN k % 2 = 0 THEN 's3.amazonaws.com' ELSE 'x' END AS service FROM ev WHERE k % 2 = 1 OR regexp_matches(lower(operation), 'getobject|listbucket|get.object|get.bucket|rest.get')) GROUP BY ALL")
def store_predicates(spark, sf_dir):
    rows = D.api_events(spark, sf_dir).select(F.col("operation").alias("api_operation"), "k", F.when(F.col("k") % 2 == 0, "s3.amazonaws.com").otherwise("x").alias("api_service"), F.lit("flow").alias("log_source"))
    kept = rows.where((F.col("k") % 2 == 1) | F.lower("api_operation").rlike(E.STORE_PATTERN))
    return kept.groupBy(F.col("api_operation").alias("operation"), E.is_store_event().alias("store_event"), E.is_store_read().alias("store_read")).agg(F.count("*").alias("n"))


@register("SELECT label, count(*) AS n FROM (SELECT CASE event_type WHEN 'view' THEN 'cloudtrail' WHEN 'click' THEN 'vpc_flow' WHEN 'error' THEN 's3_access' WHEN 'signup' THEN 's3' ELSE 'other_' || (event_id % 3) END AS label FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-20') GROUP BY label")
def sources_by_day(spark, sf_dir):
    kind = F.col("event_type")
    name = F.when(kind == "view", "CloudTrail_x.jsonl").when(kind == "click", "vpc_a_flow.jsonl").when(kind == "error", "s3_access.jsonl").when(kind == "signup", "s3_x.json").otherwise(F.concat(F.lit("other_"), (F.col("event_id") % 3).cast("string"), F.lit(".csv")))
    path = F.concat(F.lit("/in/incident/"), F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd"), F.lit("/"), name)
    rows = D.read(spark, sf_dir, "events").select(path.alias("p")).select(logs.source_label(F.col("p")).alias("label"), logs.day_of(F.col("p")).alias("day"))
    return logs.days_between(rows, "2024-01-05", "2024-01-20").groupBy("label").agg(F.count("*").alias("n"))


@register("SELECT bucket, operation, http_status, count(*) AS n, CAST(sum(b) AS BIGINT) AS bytes FROM (SELECT 'b' || (o_custkey % 4) AS bucket, 'REST.GET.OBJECT' AS operation, CASE WHEN o_orderstatus = 'F' THEN '403' ELSE '200' END AS http_status, CAST(round(o_totalprice * 100) AS BIGINT) AS b FROM orders) GROUP BY ALL")
def access_line_parse(spark, sf_dir):
    c = F.col
    line = F.concat(
        F.lit("log aws:s3:accesslogs " + "ab" * 32 + " b"), (c("o_custkey") % 4).cast("string"), F.lit(" [06/Feb/2019:00:00:38 +0000] 192.0.2.3 arn:aws:iam::1:user/u "), c("o_orderkey").cast("string"),
        F.lit(' REST.GET.OBJECT k.txt "GET /k.txt HTTP/1.1" '), F.when(c("o_orderstatus") == "F", "403").otherwise("200"), F.lit(" - "), F.round(c("o_totalprice") * 100).cast("long").cast("string"), F.lit(' 10 5 4 "-" "agent x" v1 tail'),
    )
    rows = logs.access_lines(D.read(spark, sf_dir, "orders").select(line.alias("value")))
    return rows.groupBy("bucket", "operation", "http_status").agg(F.count("*").alias("n"), F.sum(c("bytes_sent").cast("long")).alias("bytes"))


# Curves of the detectors: event deviations against failures, daily flow scores against rejects, sessions against failures.


def _judged(spark: SparkSession, sf_dir: str, detector: str) -> DataFrame:
    """(score, hit) of what a detector scores; for api (score, hit, events), counts of a combination."""
    if detector == "api":
        rows = U.api_combinations(_current(spark, sf_dir), _base(spark, sf_dir), {"hit": F.count_if(F.col("failed") & F.col("event_uid").isNotNull()), "events": F.count("event_uid")})  # the events of a combination have one score
        return rows.where("events > 0").select(X.settled(F.col("composite"), 6).alias("score"), "hit", "events")
    if detector == "session":
        return _scored(spark, sf_dir).select(X.settled(F.col("session_risk_score"), 4).alias("score"), (F.col("num_failed_events") > 0).alias("hit"))
    rejects = _split_table(D.flows(spark, sf_dir))[1].groupBy(F.col("eni").alias("actor"), F.to_date("event_time").alias("day")).agg((F.count_if(F.col("action") == "REJECT") > 0).alias("hit"))
    return _flow_scores(spark, sf_dir).join(rejects, ["actor", "day"]).select("score", "hit")


_JUDGED = """SELECT 'api' AS detector, round(round(composite, 10), 6) AS score, failed AS hit FROM comp JOIN (SELECT event_uid, failed FROM cur) USING (event_uid)
  UNION ALL SELECT 'flow', s.score, r.hit FROM fscore s JOIN (SELECT eni, CAST(event_time AS DATE) AS day, bool_or(action = 'REJECT') AS hit FROM fcur GROUP BY 1, 2) r ON r.eni = s.actor AND r.day = s.day
  UNION ALL SELECT 'session', round(round(session_risk_score, 10), 4), num_failed_events > 0 FROM risk"""
_POINTS = f"""(SELECT *, CAST(sum(positives) OVER q AS BIGINT) AS tp, CAST(sum(negatives) OVER q AS BIGINT) AS fp FROM (SELECT detector, score AS threshold, count(*) FILTER (hit) AS positives, count(*) FILTER (NOT hit) AS negatives FROM ({_JUDGED}) GROUP BY 1, 2)
  WINDOW q AS (PARTITION BY detector ORDER BY threshold DESC))"""


@register(f"SELECT threshold, tp, fp, round(tp / (SELECT max(tp) FROM {_POINTS} WHERE detector = 'session'), 6) AS recall, round(fp / (SELECT max(fp) FROM {_POINTS} WHERE detector = 'session'), 6) AS fall_out, round(tp / (tp + fp), 6) AS precision FROM {_POINTS} WHERE detector = 'session'")
def session_curve(spark, sf_dir):
    return rounded(C.curve(_judged(spark, sf_dir, "session"), "score", "hit").select("threshold", "tp", "fp", "recall", "fall_out", "precision"))


@register(f"SELECT detector, CAST(sum(positives) AS BIGINT) AS positives, CAST(sum(negatives) AS BIGINT) AS negatives, round(sum(negatives * (tp - positives / 2)) / (sum(positives) * sum(negatives)), 6) AS roc_auc, round(sum(positives * tp / (tp + fp)) / sum(positives), 6) AS average_precision FROM {_POINTS} GROUP BY detector")
def detector_areas(spark, sf_dir):
    out = [C.areas(C.curve(_judged(spark, sf_dir, name), "score", "hit", "events" if name == "api" else None)).withColumn("detector", F.lit(name)) for name in ("api", "flow", "session")]
    return rounded(out[0].unionByName(out[1]).unionByName(out[2]).select("detector", "positives", "negatives", "roc_auc", "average_precision"))


# Raw records and stored layouts.


@register("SELECT user_id % 50 AS a, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS b, CASE WHEN event_id % 10 < 3 THEN event_id % 3 END AS extra, count(*) AS copies FROM events GROUP BY ALL")
def raw_unique_records(spark, sf_dir):
    """Raw lines in two orders of keys and spacings, some with a field that no schema names: equal records meet, unequal ones stay apart."""
    a, b = (F.col("user_id") % 50).cast("string"), F.regexp_extract("props", "([0-9]+)", 1)
    extra = F.when(F.col("event_id") % 10 < 3, F.concat(F.lit(', "x": {"z": 1, "extra": '), (F.col("event_id") % 3).cast("string"), F.lit("}"))).otherwise(F.lit(""))
    other = F.when(F.col("event_id") % 10 < 3, F.concat(F.lit('"x":{"extra":'), (F.col("event_id") % 3).cast("string"), F.lit(',"z":1},'))).otherwise(F.lit(""))
    one, two = F.concat(F.lit('{"a": '), a, F.lit(', "b": '), b, extra, F.lit("}")), F.concat(F.lit("{"), other, F.lit('"b":'), b, F.lit(',"a":'), a, F.lit("}"))
    lines = D.read(spark, sf_dir, "events").select(F.when(F.col("event_id") % 2 == 0, one).otherwise(two).alias("value"))
    number = lambda path: F.get_json_object("value", path).cast("long")
    return logs.deduplicate_raw(lines).select(number("$.a").alias("a"), number("$.b").alias("b"), number("$.x.extra").alias("extra"), "copies")


@register("SELECT actor, ip, c.n AS today, b.n AS before FROM (SELECT actor, ip, count(*) AS n FROM cur GROUP BY ALL) c LEFT JOIN (SELECT actor, ip, count(*) AS n FROM base GROUP BY ALL) b USING (actor, ip)")
def bucketed_ip_history(spark, sf_dir):
    """Today's addresses beside the baseline's, from two tables bucketed by actor and address, which join without an exchange."""
    count = lambda rows, name: rows.groupBy("actor", "ip").agg(F.count("*").alias(name))
    made = []
    for rows, name in ((_current(spark, sf_dir), "today"), (_base(spark, sf_dir), "before")):
        path = stored.shared_folder(spark)
        made.append(tables.save_bucketed(count(rows, name), f"bucketed_{path.rsplit('/', 1)[-1]}", ["actor", "ip"], 16, path))
    return made[0].join(made[1].hint("merge"), ["actor", "ip"], "left")


# Readers and sinks: events are written in each form to the shared folder and read back.


def _event_structs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event structs with null fields, empty lists and structs without values."""
    c = F.col
    return D.api_events(spark, sf_dir).select(
        F.lit(6003).alias("class_uid"), F.unix_millis("event_time").alias("time"), F.when(c("failed"), 2).alias("status_id"), F.struct(F.struct(c("actor").alias("name"), "uid").alias("user")).alias("actor"),
        F.struct("operation").alias("api"), F.struct(F.when(c("k") % 4 != 0, c("ip")).alias("ip"), F.lit(None).cast("int").alias("port")).alias("src_endpoint"),
        F.when(c("k") % 3 != 0, F.array(F.struct(c("resource").alias("name")), F.lit(None))).otherwise(F.array().cast("array<struct<name:string>>")).alias("resources"),
        F.struct(F.when(c("is_system"), True).alias("is_system_actor")).alias("unmapped"), c("event_time").cast("date").alias("day"), "event_uid", "k",
    )


@register("SELECT CAST(CAST(event_time AS DATE) AS VARCHAR) AS day, operation, count(*) AS n, count(uid) AS n_uid, count(*) FILTER (WHERE failed) AS n_failed, count(*) FILTER (WHERE is_system) AS n_system, count(*) FILTER (WHERE k % 3 <> 0) AS n_resources FROM ev WHERE CAST(event_time AS DATE) BETWEEN DATE '2024-01-10' AND DATE '2024-01-19' GROUP BY ALL")
def event_lines(spark, sf_dir):
    """JSON lines in a folder per day, read back by a glob over days and beside a source that is not there."""
    path, c = stored.shared_folder(spark), F.col
    logs.write_events(logs.strip_empty(_event_structs(spark, sf_dir).drop("event_uid", "k")), path, by=["day"])
    rows = logs.union_sources([logs.read_events(spark, f"{path}/day=2024-01-1*", optional=True), logs.read_events(spark, f"{path}/none*", optional=True)])
    return rows.groupBy(c("day").cast("string").alias("day"), c("api.operation").alias("operation")).agg(
        F.count("*").alias("n"), F.count("actor.user.uid").alias("n_uid"), F.count_if(c("status_id") == 2).alias("n_failed"), F.count_if(c("unmapped.is_system_actor")).alias("n_system"), F.count_if(F.size("resources") == 1).alias("n_resources"),
    )


@register("SELECT 'actor,api,class_uid' || CASE WHEN k % 3 <> 0 THEN ',resources' ELSE '' END || CASE WHEN k % 4 <> 0 THEN ',src_endpoint' ELSE '' END || CASE WHEN failed THEN ',status_id' ELSE '' END || ',time' || CASE WHEN is_system THEN ',unmapped' ELSE '' END AS keys, count(*) AS n FROM ev GROUP BY ALL")
def stripped_keys(spark, sf_dir):
    """The keys that written events have: none holds a null, an empty list or an object without values."""
    path = stored.shared_folder(spark)
    logs.write_events(logs.strip_empty(_event_structs(spark, sf_dir).drop("day", "event_uid", "k")), path)
    return spark.read.text(path).groupBy(F.array_join(F.array_sort(F.json_object_keys("value")), ",").alias("keys")).agg(F.count("*").alias("n"))


@register("SELECT CAST(day AS VARCHAR) AS day, line_number, 'no json ' || event_id AS value FROM (SELECT event_id, CAST(ts AS DATE) AS day, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY event_id) AS line_number FROM events) WHERE event_id % 97 = 0")
def bad_line_numbers(spark, sf_dir):
    """The numbered lines of a file per day that are no JSON objects; blank lines count as lines."""
    path, e = stored.shared_folder(spark), F.col("event_uid")
    line = F.when(e % 97 == 0, F.concat(F.lit("no json "), e.cast("string"))).when(e % 89 == 0, "").otherwise(F.to_json(F.struct("time", "api")))
    rows = _event_structs(spark, sf_dir).select("day", "event_uid", line.alias("value")).repartition("day").sortWithinPartitions("day", "event_uid")
    rows.select("day", "value").write.partitionBy("day").text(path)
    return logs.bad_lines(spark, path).select(logs.day_of(F.col("input_file")).cast("string").alias("day"), "line_number", "value")


@register("SELECT CASE WHEN k % 2 = 0 THEN 'arn:aws:iam::1:user/' || actor ELSE actor END AS identity_id, operation AS event_name, failed AS is_failed, count(*) AS n FROM ev GROUP BY ALL")
def audit_documents(spark, sf_dir):
    """Raw audit records in documents under Records, in bare lists and in lines, a thousand events a file, as session events."""
    path, c = stored.shared_folder(spark), F.col
    who = F.struct(F.lit("IAMUser").alias("type"), c("actor").alias("principalId"), F.when(c("k") % 2 == 0, F.concat(F.lit("arn:aws:iam::1:user/"), "actor")).alias("arn"))
    record = F.struct(
        F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("eventTime"), c("operation").alias("eventName"), F.lit("x.amazonaws.com").alias("eventSource"), c("event_uid").cast("string").alias("eventID"),
        F.when(c("failed"), "AccessDenied").alias("errorCode"), who.alias("userIdentity"),
    )
    rows = D.api_events(spark, sf_dir).select(F.expr("event_uid div 1000").alias("file"), record.alias("r"))
    files = rows.where("file % 3 < 2").groupBy("file").agg(F.collect_list("r").alias("Records"))  # a thousand each
    text = F.when(c("file") % 3 == 0, F.to_json(F.struct("Records"))).otherwise(F.to_json("Records"))
    files.select("file", text.alias("value")).write.partitionBy("file").text(f"{path}/documents")
    rows.where("file % 3 = 2").select("r.*").write.json(f"{path}/lines")
    read = logs.union_sources([logs.read_audit(spark, f"{path}/documents", N.AUDIT_SCHEMA, True), logs.read_audit(spark, f"{path}/lines", N.AUDIT_SCHEMA, False)])
    return N.normalize_sessions(read).groupBy("identity_id", "event_name", "is_failed").agg(F.count("*").alias("n"))


@register("SELECT operation, count(*) AS n, CAST(sum(k) AS BIGINT) AS ports, max(epoch_us(event_time) // 1000) AS last_time FROM ev GROUP BY ALL")
def mixed_sources(spark, sf_dir):
    """Flattened CSV with dotted headers and JSON lines below one folder, which the inputs name twice: each event once."""
    path, c = stored.shared_folder(spark), F.col
    rows = _event_structs(spark, sf_dir).select("time", "actor", "api", F.struct(c("k").alias("port")).alias("src_endpoint"), "event_uid")
    flat = [c(p).alias(p) for p in ("time", "actor.user.name", "api.operation", "src_endpoint.port")]
    logs.write_csv(rows.where("event_uid % 2 = 0").select(*flat), f"{path}/a/flat")
    logs.write_events(rows.where("event_uid % 2 = 1").drop("event_uid"), f"{path}/b/lines")
    schema = "time long, actor struct<user:struct<name:string>>, api struct<operation:string>, src_endpoint struct<port:int>"
    read = logs.read_sources(spark, [path, f"{path}/*/flat", f"{path}/a"], schema)
    return read.groupBy(c("api.operation").alias("operation")).agg(F.count("*").alias("n"), F.sum("src_endpoint.port").alias("ports"), F.max("time").alias("last_time"))


@_same("alerts_union")
def alerts_csv(spark, sf_dir):
    """Alerts written as CSV, known columns first, and read back with their types."""
    path, alerts = stored.shared_folder(spark), alerts_union(spark, sf_dir)
    logs.write_csv(logs.alert_columns(alerts), path)
    flat = logs.read_flat_csv(spark, path)
    return flat.select(*logs.typed(flat, alerts.schema))


@register("SELECT CAST(CAST(event_time AS DATE) AS VARCHAR) AS day, actor, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes FROM ev WHERE CAST(event_time AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' GROUP BY ALL")
def results_by_day(spark, sf_dir):
    """Results of days, stored in a folder per day, of which only those of the asked days are opened."""
    path = stored.shared_folder(spark)
    daily = D.api_events(spark, sf_dir).groupBy(F.col("event_time").cast("date").alias("day"), "actor").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    logs.write_table(daily.repartition("day"), path, ["day"])
    return logs.read_results(spark, path, ("2024-01-05", "2024-01-20")).select(F.col("day").cast("string").alias("day"), "actor", "n", "bytes")
