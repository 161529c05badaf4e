"""Sessions: boundaries, features, the model and every rule of the score at its edge."""

import collections
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from vigilia.functions import exprs as X
from vigilia.functions import fixed
from vigilia.operators import sessions as S

T0 = dt.datetime(2024, 1, 1, 9)
SCHEMA = "identity_id string, event_time timestamp, event_uid long, event_name string, event_source string, source_ip string, aws_region string, is_failed boolean"


def events(spark, rows):
    """rows: (identity, seconds after T0, operation[, failed])."""
    data = [(r[0], T0 + dt.timedelta(seconds=r[1]), i, r[2], "svc", "ip", "reg", len(r) > 3 and r[3]) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, SCHEMA).withColumns({"action_category": X.action_category("event_name"), "is_sensitive": X.is_sensitive("event_name")})


def one(spark, names, step=60):
    return S.session_features(S.sessionize(events(spark, [("a", i * step, n) for i, n in enumerate(names)]), 10_000))


@pytest.mark.parametrize("bucket", [None, 1])
def test_gap_is_strict_and_numbers_run(spark, bucket):
    rows = events(spark, [("a", 0, "X"), ("a", 1800, "X"), ("a", 3601, "X"), ("b", 50, "X"), ("a", 3 * 86400, "X"), ("a", 3 * 86400, "Y")])
    got = {r.event_uid: r.session_id for r in S.sessionize(rows, 30, bucket).collect()}
    assert got == {0: "a_s1", 1: "a_s1", 2: "a_s2", 3: "b_s1", 4: "a_s3", 5: "a_s3"}


def test_result_does_not_depend_on_row_order(spark):
    rows = events(spark, [("a", (i * 37) % 400 * 60, "GetObject") for i in range(60)])
    plain = {r.event_uid: r.session_id for r in S.sessionize(rows, 30).collect()}
    for n in (1, 7):
        mixed = rows.repartition(n).orderBy(F.rand(n))
        assert {r.event_uid: r.session_id for r in S.sessionize(mixed, 30).collect()} == plain
        assert {r.event_uid: r.session_id for r in S.sessionize(mixed, 30, bucket_days=1).collect()} == plain


def test_burst_window_counts_both_ends(spark):
    for last, most in ((300, 3), (301, 2)):
        rows = S.sessionize(events(spark, [("a", s, "X") for s in (0, 150, last)]), 30)
        assert S.session_features(rows).first().max_events_in_5min == most


def test_single_event_session(spark):
    row = one(spark, ["GetObject"]).first()
    assert row.duration_minutes == 1e-6 and row.events_per_minute == pytest.approx(1e6) and row.num_getobject_events == 1


def test_key_action_minutes(spark):
    row = one(spark, ["CreateUser", "ListBuckets", "GetObject", "PutBucketPolicy"]).first()
    assert row.minutes_discovery_to_data_access == 1 and row.minutes_discovery_to_permission_change == 2
    assert row.minutes_discovery_to_credential_access is None
    assert one(spark, ["GetObject", "ListBuckets"]).first().minutes_discovery_to_data_access is None


def test_model_tables(spark):
    rows = events(spark, [("a", 0, "ListBuckets"), ("a", 1, "GetObject"), ("a", 2, "GetObject"), ("b", 0, "ListBuckets"), ("b", 1, "GetObject")])
    rows = S.sessionize(rows)
    features = S.session_features(rows)
    grams = {r.gram: (r.n, r.freq) for r in S.ngram_frequencies(features, "category2").collect()}
    assert grams == {"Discovery -> DataAccess": (2, pytest.approx(2 / 3)), "DataAccess -> DataAccess": (1, pytest.approx(1 / 3))}
    assert [r.gram for r in S.ngram_frequencies(features, "category2", 1).collect()] == ["Discovery -> DataAccess"]
    assert {(r.src, r.dst): r.prob for r in S.transition_probabilities(features).collect()} == {("Discovery", "DataAccess"): 1.0, ("DataAccess", "DataAccess"): 1.0}
    dist = {r.feature: r for r in S.feature_distributions(features).collect()}
    assert dist["num_events"].mean == 2.5 and dist["num_events"].std == 0.5 and dist["num_events"].p95 == pytest.approx(2.95) and dist["unique_services"].std == 1e-6
    assert S.common_sequences(features, rows, "event", 1).first().sequence == "ListBuckets -> GetObject"
    assert {(r.gram, r.n) for r in S.operation_pair_counts(rows).collect()} == {("ListBuckets -> GetObject", 2), ("GetObject -> GetObject", 1)}


@pytest.mark.parametrize("names, score", [
    (["ListBuckets"], 0), (["ListBuckets", "GetObject"], 6), (["GetObject", "ListBuckets"], 0), (["GetObject", "ListBuckets", "GetObject"], 6),
    (["ConsoleLogin", "ListBuckets", "GetObject"], 10), (["GetBucketPolicy", "PutBucketPolicy"], 6 + 5), (["ListBuckets"] + ["GetObject"] * 4, 6), (["ListBuckets"] + ["GetObject"] * 5, 12),
    (["StopLogging"], 0), (["StopLogging", "GetObject"], 8 + 5), (["GetObject", "StopLogging"], 0), (["ConsoleLogin", "ListRoles", "AssumeRole"], 5),
    (["ConsoleLogin", "ListBuckets", "PutBucketPolicy", "CreateAccessKey", "GetObject", "StopLogging", "GetObject"], 30),
])
def test_chain_rules(spark, names, score):
    assert S.score_chains(one(spark, names)).first().suspicious_chain_score == score


def test_published_chain_example(spark):
    # Two category pairs and one triple.
    assert S.score_chains(one(spark, ["AssumeRole", "ListRoles", "ListUsers", "AttachRolePolicy", "CreateAccessKey"])).first().suspicious_chain_score in (16, 22)


@pytest.mark.parametrize("names, score", [(["PutBucketPolicy"], 3), (["PutBucketPolicy"] * 5, 6), (["CreateUser"], 2), (["CreateUser"] * 3 + ["StopLogging"] * 3, 10), (["GetObject"] * 19, 0), (["GetObject"] * 20, 2)])
def test_sensitive_rules(spark, names, score):
    assert S.score_sensitive(one(spark, names)).first().sensitive_action_score == score


def test_whole_score_and_texts(spark):
    base = S.session_features(S.sessionize(events(spark, [(f"u{i}", j * 120, n) for i in range(6) for j, n in enumerate(["ConsoleLogin", "ListBuckets", "GetObject"][: 2 + i % 2])])))
    attack = one(spark, ["StopLogging", "ListUsers", "CreateAccessKey", "GetObject"], 30)
    row = S.score_sessions(attack, S.SessionModel(base)).first()
    assert row.session_risk_score == pytest.approx(sum(row[c] for c in S.COMPONENTS))
    assert row.sequence_rarity_score == 25 and row.timing_burst_score > 0 and 0 <= row.feature_deviation_score <= 15
    assert row.risk_explanation.startswith("This session is") and "never seen in baseline: DefenseEvasion -> Discovery" in row.risk_explanation
    assert "RARE_SEQUENCE: DefenseEvasion:[StopLogging] -> Discovery:[ListUsers]" in row.flagged_api_sequences
    assert "EVENT_PAIR: CreateAccessKey -> GetObject" in row.flagged_api_sequences and "DEFENSE_EVASION_FIRST: StopLogging preceded all other actions" in row.flagged_api_sequences
    calm = S.score_sessions(base.limit(1), S.SessionModel(base)).first()
    assert calm.session_risk_score < fixed.SESSION_MEDIUM


def test_model_writes_counts_alone(spark, monkeypatch):
    """The model needs how often category pairs and triples occur, not where, nor which calls: those are not written."""
    base = S.session_features(S.sessionize(events(spark, [("u", j * 120, n) for j, n in enumerate(["ConsoleLogin", "ListBuckets", "GetObject"])])))
    kept = []
    monkeypatch.setattr(S, "stored", lambda frame: kept.append(frame) or frame)
    model = S.SessionModel(base)
    assert kept[0].schema["grams"].dataType.elementType.names == ["kind", "gram", "n"]
    assert {g.kind for g in kept[0].first().grams} == {"category2", "category3"} and model.grams.count() == 3


def test_empty_input(spark):
    none = events(spark, [("a", 0, "X")]).limit(0)
    assert S.session_features(S.sessionize(none)).count() == 0
    assert S.score_sessions(S.session_features(S.sessionize(none)), S.SessionModel(S.session_features(S.sessionize(none)))).count() == 0


def test_categories_and_priority():
    names = fixed.category_map()
    assert names["CreateAccessKey"] == "CredentialAccess" and names["AttachRolePolicy"] == "PermissionChange" and names["GetSecretValue"] == "CredentialAccess" and names["PutObject"] == "DataAccess"
    assert sum(fixed.CT_WEIGHTS.values()) == pytest.approx(1)


def test_scores_do_not_depend_on_the_stretches(spark):
    names = ["StopLogging", "ListBuckets", "GetObject", "CreateUser", "GetSecretValue", "PutBucketPolicy", *["GetObject"] * 30, "CreateAccessKey", "AssumeRole", "PutObject"]
    rows = S.sessionize(events(spark, [("a", i * 50, n) for i, n in enumerate(names)] + [("b", i * 60, n) for i, n in enumerate(["ListBuckets", "GetObject"])]))
    model = S.SessionModel(S.session_features(rows).where("identity_id = 'b'"))
    texts = [sorted((r.session_id, r.session_risk_score, r.risk_explanation, r.flagged_api_sequences) for r in S.score_sessions(S.session_features(rows, m), model).collect()) for m in (5, 30, 100_000)]
    assert texts[0] == texts[1] == texts[2] and "RARE_SEQUENCE" in texts[0][0][3] and "BULK_ACCESS: ListBuckets -> GetObject x31" in texts[0][0][3]
    with pytest.raises(ValueError):
        S.placed_events(rows, 4)


def test_one_endless_session_per_identity_equals_brute_force(spark):
    """A gap that never ends, so that every identity is one session over many stretches, some of one event, some of many in one moment."""
    r = random.Random(11)
    names = ["ListBuckets", "GetObject", "PutObject", "StopLogging", "CreateUser", "AssumeRole", "NoCategory"]
    raw = []
    for who, n in (("a", 400), ("b", 60), ("c", 1), ("d", 2)):
        at = 0
        for _ in range(n):
            at += r.choice([0, 0, 1, 20, 100, 299, 300, 301, 1500, 4000, 30_000])
            raw.append((who, at, r.choice(names), r.random() < 0.2))
    raw = sorted(raw, key=lambda _: r.random())
    features = {f.identity_id: f for f in S.session_features(S.sessionize(events(spark, raw), 10**7)).collect()}
    pieces = {}
    for p in S.session_sequences(S.sessionize(events(spark, raw), 10**7), piece_events=37).orderBy("session_id", "piece").collect():
        pieces.setdefault(p.session_id[:1], []).extend(p.event_names)
        assert len(p.event_names) <= 37
    category = lambda n: fixed.category_map().get(n, "Other")
    for who in "abcd":
        rows = sorted((t, i, n, f) for i, (w, t, n, f) in enumerate(raw) if w == who)
        seen, got = [n for _, _, n, _ in rows], features[who]
        assert pieces[who] == seen and got.num_events == len(rows) and list(got.first_events) == seen[:5]
        assert got.max_events_in_5min == max(sum(t - 300 <= u <= t for u, *_ in rows) for t, *_ in rows)
        assert got.reads_after_listing == sum(n == "GetObject" and "ListBuckets" in seen[:i] for i, n in enumerate(seen))
        want = {}
        for i in range(len(seen)):
            cats = [category(n) for n in seen[i : i + 3]]
            for kind, gram in (("category", cats[0]), ("category2", " -> ".join(cats[:2])), ("category3", " -> ".join(cats)), ("event", seen[i])):
                if kind == "event" and gram not in S.MARKED_EVENTS or kind == "category2" and len(cats) < 2 or kind == "category3" and len(cats) < 3:
                    continue
                want.setdefault((kind, gram), []).append((i + 1, seen[i]))
        assert {(g.kind, g.gram): (g.n, g.first, g.last, [tuple(c) for c in g.calls]) for g in got.grams} == {k: (len(v), v[0][0], v[-1][0], v[: S.CALLS]) for k, v in want.items()}


def test_common_sequences_compare_whole_texts(spark, monkeypatch):
    """Sequences that differ only late are told apart, and ties go by the whole text, in rounds."""
    monkeypatch.setattr(S, "TIED_EVENTS", 2)
    long = ["GetObject"] * 40
    talks = {"a": [*long, "PutObject"], "b": [*long, "ListBuckets"], "c": [*long, "PutObject"], "d": long, "e": ["GetObject"] * 39, "f": ["CreateUser"], "g": ["StopLogging"], "h": [*long, "AssumeRole"]}
    rows = S.sessionize(events(spark, [(who, i, n) for who, ns in talks.items() for i, n in enumerate(ns)]))
    features = S.session_features(rows)
    counts = collections.Counter(" -> ".join(ns) for ns in talks.values())
    want = sorted(((t, n) for t, n in counts.items()), key=lambda x: (-x[1], x[0]))
    for keep in (1, 2, 3, 4, 5, 100):
        assert [tuple(x) for x in S.common_sequences(features, rows, "event", keep).collect()] == want[:keep]


@pytest.mark.parametrize("seed", range(3))
def test_grouped_quantiles_equal_percentile(spark, seed):
    from vigilia.operators.quantiles import grouped_quantiles

    r = random.Random(seed)
    draw = [lambda: r.random(), lambda: r.choice([0.0, 1.0, 1e-6, 2.0**52, 3.0]), lambda: -r.expovariate(1), lambda: r.gauss(0, 1) * 10 ** r.randint(-300, 300), lambda: 7.0]
    rows = [(f"g{k}", f()) for k, f in enumerate(draw) for _ in range(r.choice([1, 2, 99, 250]))] + [("g0", None), ("none", None)] + [("edge", 2.0**e) for e in range(-60, 60)] + [("edge", 2.0**e * (1 - 2.0**-53)) for e in range(-60, 60)]
    frame = spark.createDataFrame(rows, "g string, x double")
    shares = (0.0, 0.25, 0.5, 0.9, 0.95, 0.99, 1.0)
    want = {x.g: x.q for x in frame.where("x IS NOT NULL").groupBy("g").agg(F.percentile("x", F.array(*(F.lit(p) for p in shares))).alias("q")).collect()}
    got = {x.g: x.q for x in grouped_quantiles(frame, "g", "x", shares).collect()}
    assert got.keys() == want.keys() and all(got[g] == pytest.approx(want[g], rel=1e-12, abs=0) for g in want)


def test_short_sessions_take_one_aggregation_and_equal_long_ones(spark):
    names = ["ListBuckets", "GetObject", "CreateUser", "AttachUserPolicy", "GetObject", "StopLogging", "ListUsers", "GetSecretValue"]
    raw = [(who, i * step + (i // 5) * 400, names[(i * i + len(who)) % 8]) for who, n, step in (("a", 1, 1), ("bb", 7, 30), ("ccc", 40, 55), ("d", 3, 0)) for i in range(n)]
    rows = S.sessionize(events(spark, raw), 10_000)

    def told(short):
        out = {}
        for r in S.session_features(rows, short_events=short).drop("category_marks", "event_marks").collect():
            out[r.session_id] = {**r.asDict(), "grams": sorted((g.kind, g.gram, g.n, g.first, g.last, [tuple(c) for c in g.calls]) for g in r.grams)}
        return out

    alone = told(0)
    assert len(alone) == 4 and told(100) == alone and told(7) == alone
    pieces = [sorted((r.session_id, r.piece, r.event_names, r.action_categories) for r in S.session_sequences(rows, 50, short_events=n).collect()) for n in (0, 7, 100)]
    assert pieces[0] == pieces[1] == pieces[2]
    plan = S.session_features(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Expand" not in plan and "Join" not in plan
