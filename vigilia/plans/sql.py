"""Shared DuckDB views of the queries' counterparts, written from the operators' definitions."""

from __future__ import annotations

import re

from vigilia.functions import fixed
from vigilia.plans.driver_tables import CUTOFF, GAP_MINUTES, OPERATIONS, TRADE_CUTOFF


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


VIEWS = {
    "ops": f"ops(event_type, r, operation) AS (VALUES {_values((k, i, o) for k, v in OPERATIONS.items() for i, o in enumerate(v))})",
    "cats": f"cats(operation, category) AS (VALUES {_values(fixed.category_map().items())})",
    "svcs": f"svcs(operation, service) AS (VALUES {_values(fixed.service_map().items())})",
    "ev": """ev AS (SELECT event_id AS event_uid, ts AS event_time, 'u' || user_id AS actor, k, o.operation, 'res_' || k AS resource, 'ip_' || (k % 20) AS ip, 'reg_' || (k // 5) AS region,
      CAST(round(value * 100) AS BIGINT) AS bytes, r.event_type = 'error' AS failed, user_id % 10 = 0 AS is_system,
      CASE WHEN k % 5 <> 0 THEN 'AID' || user_id || '-' || (k % 3) END AS uid, 'arn:' || user_id || '/' || (k % 3) AS uid_alt, CASE WHEN k % 4 = 0 THEN 'AssumedRole' ELSE 'IAMUser' END AS type,
      coalesce(c.category, 'Other') AS category, coalesce(s.service, 'none') AS service, o.operation IN (""" + ", ".join(f"'{x}'" for x in fixed.SENSITIVE_ACTIONS) + """) AS sensitive
    FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events) r
    LEFT JOIN ops o ON r.event_type = o.event_type AND r.k % 4 = o.r LEFT JOIN cats c ON o.operation = c.operation LEFT JOIN svcs s ON o.operation = s.operation)""",
    "base": f"base AS (SELECT * FROM ev WHERE event_time < TIMESTAMP '{CUTOFF}')",
    "cur": f"cur AS (SELECT * FROM ev WHERE event_time >= TIMESTAMP '{CUTOFF}')",
    "fl": """fl AS (SELECT 'eni-' || l_suppkey AS eni, 'ip_' || (l_suppkey % 40) AS src_ip,
      CASE WHEN l_partkey % 4 = 0 THEN 'r' || (l_partkey % 200) ELSE 'd' || (l_partkey % 5) END AS dst_ip, l_linenumber AS dst_port, l_linenumber % 3 AS protocol,
      CAST(round(l_extendedprice * 100) AS BIGINT) AS bytes, CASE WHEN l_returnflag = 'R' THEN 'REJECT' ELSE 'ACCEPT' END AS action, l_shipdate AS event_time,
      l_orderkey * 10 + l_linenumber AS event_uid, l_suppkey AS suppkey, l_linestatus AS user_agent FROM lineitem)""",
    "fbase": f"fbase AS (SELECT * FROM fl WHERE event_time < TIMESTAMP '{TRADE_CUTOFF}')",
    "fcur": f"fcur AS (SELECT * FROM fl WHERE event_time >= TIMESTAMP '{TRADE_CUTOFF}')",
    "ac": """ac AS (SELECT 'c' || o_custkey AS actor, o_orderdate AS event_time, 'Op' || (o_orderkey % 3) AS operation, o_orderpriority AS bucket,
      'ip_' || (o_custkey % 7 + o_orderkey % 2) AS ip, CAST(round(o_totalprice * 100) AS BIGINT) AS bytes, CASE WHEN o_orderstatus = 'F' THEN 403 ELSE 200 END AS code, o_orderkey AS event_uid FROM orders)""",
    "abase": f"abase AS (SELECT * FROM ac WHERE event_time < TIMESTAMP '{TRADE_CUTOFF}')",
    "acur": f"acur AS (SELECT * FROM ac WHERE event_time >= TIMESTAMP '{TRADE_CUTOFF}')",
}


def sessions(source: str, p: str) -> dict[str, str]:
    """Views of a source's sessions: {p}s its events with session and place, {p}f the features."""
    gap = GAP_MINUTES * 60_000_000
    first = lambda c: f"min(CASE WHEN category = '{c}' THEN epoch_us(event_time) END)"
    minutes = lambda c: f"CASE WHEN {first(c)} >= {first('Discovery')} THEN ({first(c)} - {first('Discovery')}) / 6e7 END"
    n = lambda c: f"count(*) FILTER (category = '{c}')"
    length = f"greatest((max(epoch_us(event_time)) - min(epoch_us(event_time))) / 6e7, {fixed.SINGLE_EVENT_MINUTES})"
    return {
        f"{p}0": f"{p}0 AS (SELECT *, CASE WHEN epoch_us(event_time) - lag(epoch_us(event_time)) OVER (PARTITION BY actor ORDER BY event_time, event_uid) > {gap} THEN 1 WHEN lag(event_time) OVER (PARTITION BY actor ORDER BY event_time, event_uid) IS NULL THEN 1 ELSE 0 END AS nw FROM {source})",
        f"{p}1": f"{p}1 AS (SELECT *, CAST(sum(nw) OVER (PARTITION BY actor ORDER BY event_time, event_uid ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_number FROM {p}0)",
        f"{p}s": f"""{p}s AS (SELECT *, actor || '_s' || session_number AS session_id, row_number() OVER (PARTITION BY actor, session_number ORDER BY event_time, event_uid) AS pos,
          lead(category, 1) OVER q AS c2, lead(category, 2) OVER q AS c3, lead(operation, 1) OVER q AS o2,
          count(*) OVER (PARTITION BY actor, session_number ORDER BY epoch_us(event_time) RANGE BETWEEN 300000000 PRECEDING AND CURRENT ROW) AS burst
          FROM {p}1 WINDOW q AS (PARTITION BY actor, session_number ORDER BY event_time, event_uid))""",
        f"{p}f": f"""{p}f AS (SELECT session_id, any_value(actor) AS identity_id, min(event_time) AS session_start, max(event_time) AS session_end, {length} AS duration_minutes, count(*) AS num_events,
          count(*) / {length} AS events_per_minute, count(DISTINCT service) AS unique_services, count(DISTINCT region) AS unique_regions, count(DISTINCT ip) AS unique_source_ips,
          {n('Discovery')} AS num_discovery_actions, {n('DataAccess')} AS num_data_access_actions, {n('PermissionChange')} AS num_permission_change_actions, {n('CredentialAccess')} AS num_credential_access_actions,
          {n('Persistence')} AS num_persistence_actions, {n('DefenseEvasion')} AS num_defense_evasion_actions, count(*) FILTER (failed) AS num_failed_events, count(*) FILTER (failed) / count(*) AS failed_event_ratio,
          count(*) FILTER (operation = 'GetObject') AS num_getobject_events, count(*) FILTER (sensitive) AS num_sensitive_actions, max(burst) AS max_events_in_5min,
          {minutes('PermissionChange')} AS minutes_discovery_to_permission_change, {minutes('CredentialAccess')} AS minutes_discovery_to_credential_access, {minutes('DataAccess')} AS minutes_discovery_to_data_access,
          string_agg(category, ' -> ' ORDER BY pos) AS categories, string_agg(operation, ' -> ' ORDER BY pos) AS operations FROM {p}s GROUP BY session_id)""",
    }


VIEWS |= sessions("ev", "x") | sessions("base", "b") | sessions("cur", "c")

_features = ", ".join(f"CAST({f} AS DOUBLE) AS {f}" for f in fixed.DISTRIBUTION_FEATURES)
VIEWS["grams2"] = f"grams2 AS (SELECT category || ' -> ' || c2 AS gram, count(*) AS n FROM bs WHERE c2 IS NOT NULL GROUP BY 1)"
VIEWS["grams3"] = f"grams3 AS (SELECT category || ' -> ' || c2 || ' -> ' || c3 AS gram, count(*) AS n FROM bs WHERE c3 IS NOT NULL GROUP BY 1)"
VIEWS["model"] = f"""model AS (SELECT * FROM (SELECT gram, n / (SELECT sum(n) FROM grams2) AS freq FROM grams2 ORDER BY n DESC, gram LIMIT {fixed.NGRAM_KEEP})
    UNION ALL SELECT * FROM (SELECT gram, n / (SELECT sum(n) FROM grams3) AS freq FROM grams3 ORDER BY n DESC, gram LIMIT {fixed.NGRAM_KEEP}))"""
VIEWS["dist"] = f"""dist AS (SELECT feature, avg(x) AS mean, CASE WHEN stddev_pop(x) > 0 THEN stddev_pop(x) ELSE 1e-6 END AS std, quantile_cont(x, 0.5) AS p50, quantile_cont(x, 0.9) AS p90,
    quantile_cont(x, 0.95) AS p95, quantile_cont(x, 0.99) AS p99, min(x) AS min, max(x) AS max FROM (UNPIVOT (SELECT {_features} FROM bf) ON COLUMNS(*) INTO NAME feature VALUE x) GROUP BY feature)"""
VIEWS["rarity"] = """rarity AS (SELECT session_id, least(avg(1 - coalesce(freq, 0)) * 25, 25) AS sequence_rarity_score FROM (
    SELECT session_id, category || ' -> ' || c2 AS gram FROM cs WHERE c2 IS NOT NULL UNION ALL SELECT session_id, category || ' -> ' || c2 || ' -> ' || c3 FROM cs WHERE c3 IS NOT NULL) g
    LEFT JOIN model USING (gram) GROUP BY session_id)"""


def _chain() -> tuple[str, str]:
    """First and last places of what the rules name, and the score of the rules that hold."""
    cat = sorted({c for pair in fixed.CATEGORY_CHAINS + fixed.CATEGORY_TRIPLES for c in pair})
    op = sorted({o for pair in fixed.EVENT_PAIRS for o in pair} | {"ListBuckets"})
    positions = ", ".join([f"min(pos) FILTER (category = '{c}') AS a_{c}, max(pos) FILTER (category = '{c}') AS z_{c}" for c in cat] + [f"min(pos) FILTER (operation = '{o}') AS a_{o}, max(pos) FILTER (operation = '{o}') AS z_{o}" for o in op])
    rules = [f"CASE WHEN a_{a} < z_{b} THEN 6 ELSE 0 END" for a, b in fixed.CATEGORY_CHAINS] + [f"CASE WHEN a_{a} < a_{b} AND a_{b} < z_{c} THEN 4 ELSE 0 END" for a, b, c in fixed.CATEGORY_TRIPLES]
    rules += [f"CASE WHEN a_{a} < z_{b} THEN 5 ELSE 0 END" for a, b in fixed.EVENT_PAIRS]
    rules += ["CASE WHEN reads >= 5 THEN 6 ELSE 0 END", "CASE WHEN evades AND n > 1 THEN 8 ELSE 0 END"]
    return f"""placed AS (SELECT session_id, count(*) AS n, bool_or(pos = 1 AND category = 'DefenseEvasion') AS evades, count(*) FILTER (operation = 'GetObject' AND pos > listed) AS reads, {positions}
      FROM (SELECT *, min(CASE WHEN operation = 'ListBuckets' THEN pos END) OVER (PARTITION BY session_id) AS listed FROM cs) GROUP BY session_id)""", f"chain AS (SELECT session_id, least(CAST({' + '.join(rules)} AS DOUBLE), 30) AS suspicious_chain_score FROM placed)"


VIEWS["placed"], VIEWS["chain"] = _chain()
_d = lambda f, k: f"(SELECT {k} FROM dist WHERE feature = '{f}')"
_burst = lambda f: f"CASE WHEN {_d(f, 'p95')} > 0 AND {f} > {_d(f, 'p95')} THEN 7 * (least({f} / {_d(f, 'p95')}, 3) - 1) / 2 ELSE 0 END"
_quick = lambda n: f"CASE WHEN minutes_discovery_to_{n} <= 10 THEN 6 ELSE 0 END"
VIEWS["timing"] = f"timing AS (SELECT session_id, least({_burst('events_per_minute')} + {_burst('max_events_in_5min')} + {_quick('permission_change')} + {_quick('credential_access')} + {_quick('data_access')}, 20.0) AS timing_burst_score FROM cf)"
VIEWS["deviant"] = "deviant AS (SELECT session_id, least((" + " + ".join(f"abs(({f} - {_d(f, 'mean')}) / {_d(f, 'std')})" for f in fixed.DEVIATION_FEATURES) + ") / 6 / 4 * 15, 15.0) AS feature_deviation_score FROM cf)"
VIEWS["sensi"] = "sensi AS (SELECT session_id, least(" + " + ".join(f"least(num_{n}_actions * {w}, {2 * w})" for n, _, w in fixed.SENSITIVE_WEIGHTS) + " + CASE WHEN num_data_access_actions >= 20 THEN 2 ELSE 0 END, 10.0) AS sensitive_action_score FROM cf)"
VIEWS["risk"] = """risk AS (SELECT cf.*, coalesce(sequence_rarity_score, 0) AS sequence_rarity_score, suspicious_chain_score, timing_burst_score, feature_deviation_score, sensitive_action_score,
    least(greatest(coalesce(sequence_rarity_score, 0) + suspicious_chain_score + timing_burst_score + feature_deviation_score + sensitive_action_score, 0), 100) AS session_risk_score
    FROM cf LEFT JOIN rarity USING (session_id) JOIN chain USING (session_id) JOIN timing USING (session_id) JOIN deviant USING (session_id) JOIN sensi USING (session_id))"""

# Texts of the session score.

_num = lambda x, d: f"CAST(round(CAST({x} AS DECIMAL(38, 10)), {d}) AS VARCHAR)"  # noqa: E731  decimals are rounded half up
_text = lambda c, n: f"coalesce(array_to_string(k_{c}[1:{n}], ', '), '')"
_cats = sorted({c for pair in fixed.CATEGORY_CHAINS + fixed.CATEGORY_TRIPLES for c in pair} | {c for _, c, _ in fixed.SENSITIVE_WEIGHTS} | {"DefenseEvasion", "DataAccess", "Discovery"})
VIEWS["firsts"] = "firsts AS (SELECT session_id, category, list(operation ORDER BY pos)[1:6] AS calls FROM cs GROUP BY 1, 2)"
VIEWS["called"] = "called AS (SELECT session_id, list(operation ORDER BY pos)[1:5] AS head, " + ", ".join(f"list(operation ORDER BY pos) FILTER (category = '{c}') AS k_{c}" for c in _cats) + " FROM cs GROUP BY 1)"
_shown = lambda c, f: f"{c} || ':[' || coalesce(array_to_string({f}.calls[1:3], ', '), '') || ']'"
VIEWS["unseen"] = f"""unseen AS (SELECT session_id, list(gram ORDER BY kind, pos) AS grams, list(told ORDER BY kind, pos) AS told FROM (
    SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY kind, pos) AS r FROM (
      SELECT s.session_id, 2 AS kind, pos, s.category || ' -> ' || c2 AS gram, 'RARE_SEQUENCE: ' || {_shown('s.category', 'f1')} || ' -> ' || {_shown('c2', 'f2')} AS told FROM cs s
        LEFT JOIN firsts f1 ON f1.session_id = s.session_id AND f1.category = s.category LEFT JOIN firsts f2 ON f2.session_id = s.session_id AND f2.category = s.c2 WHERE c2 IS NOT NULL
      UNION ALL SELECT s.session_id, 3, pos, s.category || ' -> ' || c2 || ' -> ' || c3, 'RARE_SEQUENCE: ' || {_shown('s.category', 'f1')} || ' -> ' || {_shown('c2', 'f2')} || ' -> ' || {_shown('c3', 'f3')} FROM cs s
        LEFT JOIN firsts f1 ON f1.session_id = s.session_id AND f1.category = s.category LEFT JOIN firsts f2 ON f2.session_id = s.session_id AND f2.category = s.c2
        LEFT JOIN firsts f3 ON f3.session_id = s.session_id AND f3.category = s.c3 WHERE c3 IS NOT NULL) WHERE gram NOT IN (SELECT gram FROM model)) WHERE r <= 3 GROUP BY session_id)"""


def _rules() -> list[tuple[str, str, str]]:
    """(condition, reason, flag) of every rule but rarity, in the order in which they are told."""
    quote = lambda x: f"'{x}'"
    box = lambda c: f"'[' || {_text(c, 3)} || ']'"
    out = [(f"a_{a} < z_{b}", quote(f"{a} -> {b} chain present"), f"'CHAIN {a}->{b}: ' || {box(a)} || ' -> ' || {box(b)}") for a, b in fixed.CATEGORY_CHAINS]
    out += [(f"a_{a} < a_{b} AND a_{b} < z_{c}", quote(f"{a} -> {b} -> {c} chain present"), f"'TRIPLE {a}->{b}->{c}: ' || {box(a)} || ' -> ' || {box(b)} || ' -> ' || {box(c)}") for a, b, c in fixed.CATEGORY_TRIPLES]
    out += [(f"a_{a} < z_{b}", quote(f"{a} followed by {b}"), quote(f"EVENT_PAIR: {a} -> {b}")) for a, b in fixed.EVENT_PAIRS]
    out.append(("reads >= 5", "'ListBuckets followed by ' || reads || ' GetObject calls (bulk access)'", "'BULK_ACCESS: ListBuckets -> GetObject x' || reads"))
    out.append(("evades AND num_events > 1", quote("DefenseEvasion action occurred before other activity in the session"), f"'DEFENSE_EVASION_FIRST: ' || {_text('DefenseEvasion', 1)} || ' preceded all other actions'"))
    head = "array_to_string(head, ', ') || CASE WHEN num_events > 5 THEN '...' ELSE '' END"
    for f in ("events_per_minute", "max_events_in_5min"):
        p95 = _d(f, "p95")
        out.append((f"{p95} > 0 AND {f} > {p95}", f"'{f}=' || {_num(f, 2)} || ' exceeds baseline p95 (' || {_num(p95, 2)} || ')'", f"'BURST_RATE ({f}=' || {_num(f, 2)} || ' vs p95=' || {_num(p95, 2)} || '): [' || {head} || ']'"))
    for name, c in (("permission_change", "PermissionChange"), ("credential_access", "CredentialAccess"), ("data_access", "DataAccess")):
        m = f"minutes_discovery_to_{name}"
        out.append((f"{m} <= 10", f"'fast progression from Discovery to {c} in ' || {_num(m, 1)} || ' minutes'", f"'FAST_PROGRESSION (' || {_num(m, 1)} || 'min): ' || {_text('Discovery', 1)} || ' -> ... -> ' || {_text(c, 1)}"))
    for f in fixed.DEVIATION_FEATURES:
        z = f"abs(({f} - {_d(f, 'mean')}) / {_d(f, 'std')})"
        out.append((f"{z} > 3", f"'{f}=' || {_num(f, 2)} || ' is far from baseline (z=' || {_num(z, 1)} || ')'", f"'DEVIATION {f}=' || {_num(f, 2)} || ' (z=' || {_num(z, 1)} || ', baseline_mean=' || {_num(_d(f, 'mean'), 2)} || ')'"))
    for name, c, _ in fixed.SENSITIVE_WEIGHTS:
        n = f"num_{name}_actions"
        out.append((f"{n} > 0", f"{n} || ' {name} action(s)'", f"'SENSITIVE {c} (x' || {n} || '): ' || {_text(c, 6)}"))
    n = "num_data_access_actions"
    out.append((f"{n} >= 20", f"'high-volume data access (' || {n} || ' events)'", f"'HIGH_VOLUME_DATA_ACCESS (x' || {n} || '): ' || {_text('DataAccess', 5)} || '...'"))
    return out


_told = lambda k: "list_filter([" + ", ".join(f"CASE WHEN {r[0]} THEN {r[k]} END" for r in _rules()) + "], lambda x: x IS NOT NULL)"
VIEWS["explained"] = f"""explained AS (SELECT session_id, CASE WHEN len(why) = 0 THEN 'This session matches normal baseline behavior; no notable risk signals.' ELSE
      'This session is ' || CASE WHEN session_risk_score >= {fixed.SESSION_HIGH} THEN 'high' WHEN session_risk_score >= {fixed.SESSION_MEDIUM} THEN 'medium' ELSE 'low' END || ' risk because it ' || array_to_string(why[1:5], '; ')
      || ', within a ' || {_num('duration_minutes', 1)} || '-minute window (' || num_events || ' events).' END AS risk_explanation,
    CASE WHEN len(flags) = 0 THEN 'none' ELSE array_to_string(flags, ' | ') END AS flagged_api_sequences FROM (
    SELECT risk.*, list_concat(CASE WHEN grams IS NULL THEN [] ELSE ['contains rare action chain(s) never seen in baseline: ' || array_to_string(grams, ', ')] END, {_told(1)}) AS why, list_concat(coalesce(told, []), {_told(2)}) AS flags
    FROM risk JOIN placed USING (session_id) JOIN called USING (session_id) LEFT JOIN unseen USING (session_id)))"""

# Baselines and scores of actors.


def deviation(x: str, mean: str, std: str) -> str:
    return f"CASE WHEN {std} > 0 THEN least(abs(({x} - {mean}) / {std} / 3), 1.0) WHEN {x} > {mean} THEN least(({x} - {mean}) / greatest({mean}, 1.0), 1.0) ELSE 0.0 END"


def slots(name: str, source: str, by: str, unit: str, value: str = "count(*)") -> str:
    return f"{name} AS (SELECT {by}, round(round(avg(x), 10), 4) AS mean, round(round(coalesce(stddev_samp(x), 0), 10), 4) AS std, count(*) AS slots FROM (SELECT {by}, CAST({value} AS DOUBLE) AS x FROM {source} GROUP BY {by}, date_trunc('{unit}', event_time)) GROUP BY {by})"


VIEWS["hslots"] = slots("hslots", "base", "actor", "hour")
VIEWS["dslots"] = slots("dslots", "base", "actor", "day")
VIEWS["hcount"] = "hcount AS (SELECT actor, CAST(hour(event_time) AS INT) AS hour, count(*) AS n FROM base GROUP BY ALL)"
VIEWS["dims"] = f"""dims AS (SELECT c.actor, c.event_uid, CAST(c.event_time AS DATE) AS day,
    CASE WHEN o.operation IS NULL THEN 1.0 ELSE 0.0 END AS d_op, CASE WHEN r.resource IS NULL THEN 1.0 ELSE 0.0 END AS d_resource, CASE WHEN g.region IS NULL THEN 1.0 ELSE 0.0 END AS d_region,
    {deviation('c.slot', 'h.mean', 'h.std')} AS d_volume, CASE WHEN i.ip IS NULL AND g.region IS NOT NULL THEN 1.0 ELSE 0.0 END AS d_ip, 1 - coalesce(k.n, 0) / p.peak AS d_hour
    FROM (SELECT *, count(*) OVER (PARTITION BY actor, date_trunc('hour', event_time)) AS slot FROM cur) c JOIN hslots h ON c.actor = h.actor
    JOIN (SELECT actor, max(n) AS peak FROM hcount GROUP BY actor) p ON c.actor = p.actor LEFT JOIN hcount k ON c.actor = k.actor AND k.hour = hour(c.event_time)
    LEFT JOIN (SELECT DISTINCT actor, operation FROM base) o ON c.actor = o.actor AND c.operation = o.operation LEFT JOIN (SELECT DISTINCT actor, resource FROM base) r ON c.actor = r.actor AND c.resource = r.resource
    LEFT JOIN (SELECT DISTINCT actor, region FROM base) g ON c.actor = g.actor AND c.region = g.region LEFT JOIN (SELECT DISTINCT actor, ip FROM base) i ON c.actor = i.actor AND c.ip = i.ip)"""
VIEWS["comp"] = "comp AS (SELECT *, " + " + ".join(f"{d} * {w}" for d, w in fixed.CT_WEIGHTS.items()) + " AS composite FROM dims)"
VIEWS["aprof"] = "aprof AS (SELECT actor, CAST(event_time AS DATE) AS day, count(*) AS event_count, CAST(sum(bytes) AS BIGINT) AS bytes_total, count(*) FILTER (code <> 200) AS error_count FROM acur GROUP BY ALL)"
VIEWS["adaye"] = slots("adaye", "abase", "actor", "day")
VIEWS["adayb"] = slots("adayb", "abase", "actor", "day", "sum(bytes)")
_fresh = lambda src, base, by, col: f"(SELECT DISTINCT {by}, CAST(event_time AS DATE) AS day FROM {src} s WHERE NOT EXISTS (SELECT 1 FROM {base} b WHERE b.{by} = s.{by} AND b.{col} = s.{col}))"


def _six(name: str, prof: str, src: str, base: str, by: str, stats: tuple[str, str], cols: tuple[str, str, str], names: tuple[str, ...], share: str) -> str:
    log = "CASE WHEN p.bytes_total IS NULL OR p.bytes_total = 0 THEN 0.0 ELSE least(log10(p.bytes_total + 1.0) / log10(1e12 + 1), 1.0) END"
    e, b = stats
    new = [f"CASE WHEN e.mean IS NULL OR n{i}.day IS NOT NULL THEN 1.0 ELSE 0.0 END AS v{i}" for i in range(3)]
    joins = " ".join(f"LEFT JOIN {_fresh(src, base, by, c)} n{i} ON n{i}.{by} = p.{by} AND n{i}.day = p.day" for i, c in enumerate(cols))
    six = f"""(SELECT p.{by}, p.day, p.event_count, e.mean IS NOT NULL AS has_baseline, {', '.join(new)}, p.{share} / p.event_count AS share,
      CASE WHEN e.mean IS NULL THEN {log} ELSE {deviation('p.bytes_total', 'b.mean', 'b.std')} END AS vb, CASE WHEN e.mean IS NULL THEN 1.0 ELSE {deviation('p.event_count', 'e.mean', 'e.std')} END AS ve
      FROM {prof} p LEFT JOIN {e} e ON e.{by} = p.{by} LEFT JOIN {b} b ON b.{by} = p.{by} {joins})"""
    order = dict(zip(("v0", "v1", "v2", "share", "vb", "ve"), names))
    return f"{name} AS (SELECT {by} AS actor, day, event_count, has_baseline, round(round((v0 + v1 + v2 + share + vb + ve) / 6, 10), 4) AS score, {', '.join(f'round(round({k}, 10), 4) AS {v}' for k, v in order.items())} FROM {six})"


VIEWS["ascore"] = _six("ascore", "aprof", "acur", "abase", "actor", ("adaye", "adayb"), ("operation", "bucket", "ip"), ("new_operation", "new_bucket", "new_src_ip", "error_rate", "bytes_zscore", "event_zscore"), "error_count")
VIEWS["fprof"] = "fprof AS (SELECT eni, CAST(event_time AS DATE) AS day, count(*) AS event_count, CAST(sum(bytes) AS BIGINT) AS bytes_total, count(*) FILTER (action = 'REJECT') AS reject_count FROM fcur GROUP BY ALL)"
VIEWS["fports"] = "fports AS (SELECT eni, CAST(event_time AS DATE) AS day, dst_port, min(event_time) AS event_time FROM fcur GROUP BY 1, 2, 3 HAVING count(*) > 1)"
VIEWS["fdaye"] = slots("fdaye", "fbase", "eni", "day")
VIEWS["fdayb"] = slots("fdayb", "fbase", "eni", "day", "sum(bytes)")
VIEWS["fscore"] = _six("fscore", "fprof", "fcur", "fbase", "eni", ("fdaye", "fdayb"), ("dst_ip", "dst_port", "protocol"), ("new_dst_ip", "new_dst_port", "new_protocol", "reject_ratio", "bytes_zscore", "flow_zscore"), "reject_count").replace(_fresh("fcur", "fbase", "eni", "dst_port"), _fresh("fports", "fbase", "eni", "dst_port"))
VIEWS["cscore"] = "cscore AS (SELECT actor, day, round(round(avg(composite), 10), 4) AS score, round(round(max(composite), 10), 4) AS score_max, count(*) AS event_count, " + ", ".join(f"round(round(avg({d}), 10), 4) AS {d}" for d in fixed.CT_WEIGHTS) + " FROM comp GROUP BY actor, day)"
VIEWS["final"] = """final AS (SELECT coalesce(c.actor, a.actor, f.actor) AS actor, CAST(coalesce(c.day, a.day, f.day) AS DATE) AS day, greatest(c.score, a.score, f.score) AS final_score,
    concat_ws(',', CASE WHEN c.score IS NOT NULL THEN 'cloudtrail' END, CASE WHEN a.score IS NOT NULL THEN 's3' END, CASE WHEN f.score IS NOT NULL THEN 'vpc' END) AS sources_used,
    c.score AS api_score, a.score AS access_score, f.score AS flow_score, c.score IS NOT NULL OR coalesce(a.has_baseline, false) OR coalesce(f.has_baseline, false) AS has_any_baseline
    FROM cscore c FULL JOIN ascore a ON a.actor = c.actor AND a.day = c.day FULL JOIN fscore f ON f.actor = coalesce(c.actor, a.actor) AND f.day = coalesce(c.day, a.day))"""

# Exfiltration.

VIEWS["net"] = f"""net AS (SELECT f.eni, f.src_ip, f.dst_ip AS destination, f.event_time, f.event_uid, f.bytes, f.user_agent, f.dst_port,
    d.dst_ip IS NULL AS rare_destination, u.user_agent IS NULL AS rare_user_agent, r.dst_port IS NULL AS rare_resource FROM fcur f
    LEFT JOIN (SELECT DISTINCT eni, dst_ip FROM fbase) d ON d.eni = f.eni AND d.dst_ip = f.dst_ip LEFT JOIN (SELECT DISTINCT eni, user_agent FROM fbase) u ON u.eni = f.eni AND u.user_agent = f.user_agent
    LEFT JOIN (SELECT DISTINCT eni, dst_port FROM fbase) r ON r.eni = f.eni AND r.dst_port = f.dst_port)"""
VIEWS["netf"] = f"""netf AS (SELECT eni AS interface_uid, destination, CAST(sum(bytes) AS BIGINT) AS total_bytes_out, count(*) AS event_count, avg(bytes) AS avg_bytes_out, median(bytes) AS median_bytes_out, max(bytes) AS max_bytes_out,
    count(*) FILTER (bytes <= {fixed.SMALL_TRANSFER}) AS small_transfer_count, count(*) FILTER (rare_destination) AS rare_destination_event_count, count(*) FILTER (rare_user_agent) AS rare_user_agent_event_count,
    count(DISTINCT user_agent) AS distinct_user_agents, (max(epoch_us(event_time)) - min(epoch_us(event_time))) / 3.6e9 AS duration_hours,
    count(*) FILTER (bytes <= {fixed.SMALL_TRANSFER}) / count(*) AS small_transfer_ratio, count(*) FILTER (rare_destination) / count(*) AS rare_destination_ratio, count(*) FILTER (rare_user_agent) / count(*) AS rare_user_agent_ratio
    FROM net WHERE bytes > 0 GROUP BY eni, destination)"""
VIEWS["gaps"] = "gaps AS (SELECT *, median(d) OVER (PARTITION BY eni, destination) AS m FROM (SELECT eni, destination, (epoch_us(event_time) - lag(epoch_us(event_time)) OVER (PARTITION BY eni, destination ORDER BY event_time, event_uid)) / 1e6 AS d FROM net WHERE bytes > 0) WHERE d IS NOT NULL)"
VIEWS["timf"] = f"""timf AS (SELECT eni AS interface_uid, destination, avg(d) AS mean_interval_seconds, stddev_samp(d) AS std_interval_seconds, any_value(m) AS median_interval_seconds, min(d) AS min_interval_seconds, max(d) AS max_interval_seconds,
    count(*) AS interval_count, avg(CASE WHEN m > 0 THEN CASE WHEN d BETWEEN m * {1 - fixed.BAND} AND m * {1 + fixed.BAND} THEN 1.0 ELSE 0.0 END END) AS interval_median_band_ratio,
    stddev_samp(d) / nullif(avg(d), 0) AS interval_cv FROM gaps GROUP BY eni, destination)"""
VIEWS["p95"] = "p95 AS (SELECT eni AS interface_uid, quantile_cont(b, 0.95) AS p95_bytes, quantile_cont(n, 0.95) AS p95_events FROM (SELECT eni, CAST(sum(bytes) AS DOUBLE) AS b, CAST(count(*) AS DOUBLE) AS n FROM fbase GROUP BY eni, CAST(event_time AS DATE)) GROUP BY eni)"
VIEWS["nets"] = f"""nets AS (SELECT n.*, round(least(
    CASE WHEN event_count >= 20 THEN 15 ELSE 0 END + CASE WHEN small_transfer_ratio >= 0.8 THEN 15 ELSE 0 END + CASE WHEN duration_hours >= 6 THEN 10 ELSE 0 END + CASE WHEN total_bytes_out >= {fixed.MIN_TOTAL_BYTES} THEN 20 ELSE 0 END
    + CASE WHEN p95_bytes > 0 AND total_bytes_out > p95_bytes THEN 15 ELSE 0 END + CASE WHEN p95_events > 0 AND event_count > p95_events THEN 10 ELSE 0 END + CASE WHEN rare_destination_ratio >= 0.5 THEN 20 ELSE 0 END
    + CASE WHEN rare_user_agent_ratio >= 0.5 THEN 10 ELSE 0 END
    + CASE WHEN interval_count >= 10 AND (interval_cv <= 0.25 OR (interval_cv <= 0.35 AND interval_median_band_ratio >= 0.8)) THEN 15 ELSE 0 END, 170) / 170 * 100, 2) AS network_risk_score
    FROM netf n LEFT JOIN timf t USING (interface_uid, destination) LEFT JOIN p95 p USING (interface_uid))"""

_reading = "operation IN ('GetObject', 'ListBuckets', 'HeadObject', 'PutObject')"
VIEWS["reads"] = f"""reads AS (SELECT e.actor AS principal, CAST(e.event_time AS DATE) AS access_day, e.bytes, e.resource, r.resource IS NULL AS rare, e.event_time FROM cur e
    LEFT JOIN (SELECT DISTINCT actor, resource FROM base) r ON r.actor = e.actor AND r.resource = e.resource WHERE {_reading})"""
VIEWS["daily"] = "daily AS (SELECT principal, access_day, CAST(sum(greatest(bytes, 0)) AS BIGINT) AS b, count(*) AS n, count(DISTINCT resource) AS res, count(*) FILTER (rare) AS rare_n FROM reads GROUP BY ALL)"
VIEWS["bdaily"] = f"bdaily AS (SELECT actor AS principal, CAST(event_time AS DATE) AS access_day, CAST(sum(greatest(bytes, 0)) AS BIGINT) AS b, count(*) AS n FROM base WHERE {_reading} GROUP BY ALL)"
VIEWS["tbase"] = """tbase AS (SELECT principal, count(*) AS baseline_days, avg(b) AS baseline_avg_daily_bytes, quantile_cont(CAST(b AS DOUBLE), 0.95) AS baseline_p95_daily_bytes, coalesce(stddev_samp(b), 0) AS baseline_std_daily_bytes,
    avg(n) AS baseline_avg_daily_events, quantile_cont(CAST(n AS DOUBLE), 0.95) AS baseline_p95_daily_events, CAST(sum(b) AS BIGINT) AS baseline_total_bytes, CAST(sum(n) AS BIGINT) AS baseline_total_events FROM bdaily GROUP BY principal)"""
VIEWS["ratio"] = """ratio AS (SELECT d.*, t.*  EXCLUDE (principal), CASE WHEN baseline_avg_daily_bytes > 0 THEN b / baseline_avg_daily_bytes END AS bytes_ratio,
    CASE WHEN baseline_avg_daily_events > 0 THEN n / baseline_avg_daily_events END AS event_ratio FROM daily d JOIN tbase t ON d.principal = t.principal)"""
VIEWS["act"] = """act AS (SELECT *, greatest(bytes_ratio, event_ratio) AS activity_ratio, coalesce(greatest(bytes_ratio, event_ratio), 0) AS x, row_number() OVER (PARTITION BY principal ORDER BY access_day) AS e,
    row_number() OVER (PARTITION BY principal ORDER BY access_day DESC) AS l FROM ratio)"""
VIEWS["timef"] = """timef AS (SELECT principal, any_value(baseline_days) AS baseline_days, count(DISTINCT access_day) AS current_days, count(*) FILTER (x >= 2.5) AS elevated_days, count(*) FILTER (x >= 4) AS spike_days,
    avg(x) AS avg_activity_ratio, max(x) AS max_activity_ratio, avg(x) FILTER (e <= 3) AS early3_avg_ratio, avg(x) FILTER (l <= 3) AS final3_avg_ratio,
    CASE WHEN count(*) < 2 THEN 0 ELSE regr_slope(x, date_diff('day', DATE '1970-01-01', access_day)) END AS trend_slope_ratio_per_day, CAST(sum(res) AS BIGINT) AS total_distinct_resource_day_count, CAST(sum(rare_n) AS BIGINT) AS rare_resource_event_count,
    CAST(sum(b) AS BIGINT) AS total_current_bytes, CAST(sum(n) AS BIGINT) AS total_current_events, any_value(baseline_avg_daily_bytes) * count(DISTINCT access_day) AS expected_current_bytes,
    any_value(baseline_avg_daily_events) * count(DISTINCT access_day) AS expected_current_events, date_diff('day', min(access_day), max(access_day)) + 1 AS duration_days FROM act GROUP BY principal)"""
VIEWS["timed"] = f"""timed AS (SELECT *, total_current_bytes - expected_current_bytes AS cumulative_excess_bytes,
    current_days >= 7 AND elevated_days >= 7 AND avg_activity_ratio >= 2.5 AS sustained,
    current_days >= 7 AND trend_slope_ratio_per_day >= 0.12 AND final3_avg_ratio >= 3 AND final3_avg_ratio > greatest(early3_avg_ratio * 1.5, early3_avg_ratio + 0.75) AS ramp,
    current_days >= 7 AND spike_days >= 4 AND spike_days < current_days AND max_activity_ratio >= 4 AS periodic,
    (coalesce(total_current_bytes / nullif(expected_current_bytes, 0) >= 2, false) OR coalesce(total_current_events / nullif(expected_current_events, 0) >= 2, false))
      AND total_current_bytes - expected_current_bytes >= {fixed.MIN_TOTAL_BYTES} AS cumulative FROM timef)"""
VIEWS["times"] = """times AS (SELECT *, round(least(CASE WHEN sustained THEN 40 ELSE 0 END + CASE WHEN avg_activity_ratio >= 2.5 THEN 15 ELSE 0 END + CASE WHEN ramp THEN 35 ELSE 0 END + CASE WHEN final3_avg_ratio >= 3 THEN 15 ELSE 0 END
    + CASE WHEN periodic THEN 35 ELSE 0 END + CASE WHEN cumulative THEN 25 ELSE 0 END + CASE WHEN total_distinct_resource_day_count >= 50 THEN 10 ELSE 0 END + CASE WHEN rare_resource_event_count >= 10 THEN 10 ELSE 0 END
    + CASE WHEN current_days >= 10 THEN 5 ELSE 0 END, 155) / 155 * 100, 2) AS time_based_risk_score,
    coalesce(nullif(concat_ws('|', CASE WHEN sustained THEN 'sustained_elevation' END, CASE WHEN ramp THEN 'ramp_up' END, CASE WHEN periodic THEN 'periodic_spikes' END, CASE WHEN cumulative THEN 'cumulative_excess' END), ''), 'time_anomaly_weak_signal') AS time_detection_types FROM timed)"""


def query(final: str) -> str:
    """A statement with the views that it needs, in the order they need each other."""
    words = {name: set(re.findall(r"\w+", text.split(" AS ", 1)[1])) for name, text in VIEWS.items()}
    needed: list[str] = []
    begun: set[str] = set()

    def visit(text_words: set[str]) -> None:
        for name in VIEWS:
            if name in text_words and name not in begun:
                begun.add(name)
                visit(words[name])
                needed.append(name)

    visit(set(re.findall(r"\w+", final)))
    return ("WITH " + ",\n".join(VIEWS[n] for n in needed) + "\n" if needed else "") + final
