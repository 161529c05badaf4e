"""Reading, raw-text parsing, normalisation and sinks."""

import json

import pytest
from pyspark.sql import functions as F

from vigilia.functions import exprs as X
from vigilia.operators import normalize as N
from vigilia.sources import logs

EVENT = {"class_uid": 6003, "time": 1534755721000, "actor": {"user": {"name": "alice", "uid_alt": "arn:aws:sts::1:assumed-role/r/sess"}}, "api": {"operation": "REST.GET.OBJECT"}, "status_id": 2, "unmapped": {"bytes_sent": "-"}}


def test_reading_lines(spark, tmp_path):
    day = tmp_path / "incident" / "2018-08-20"
    day.mkdir(parents=True)
    (day / "cloudtrail_ocsf.jsonl").write_text(json.dumps(EVENT) + "\n\n" + "not json\n")
    (tmp_path / "vpc_flow.jsonl").write_text(json.dumps({"class_uid": 4001, "time": 5}) + "\n")
    (tmp_path / "notes.txt").write_text("no")
    rows = logs.read_events(spark, str(tmp_path)).cache()
    assert {(r.source, r.n) for r in rows.groupBy("source").agg(F.count("*").alias("n")).collect()} == {("cloudtrail", 2), ("vpc_flow", 1)}
    assert {(r.source, r.mapped, r.failed) for r in logs.read_counts(rows, ["source"]).collect()} == {("cloudtrail", 1, 1), ("vpc_flow", 1, 0)}
    assert logs.days_between(rows, "2018-08-19", "2018-08-20").count() == 2 and logs.days_between(rows, "2018-08-21", "2018-09-01").count() == 0
    with pytest.raises(Exception):
        logs.read_events(spark, str(day), strict=True).collect()
    with pytest.raises(FileNotFoundError):
        logs.read_events(spark, str(tmp_path / "missing"))
    assert logs.read_events(spark, str(tmp_path / "missing*"), optional=True).count() == 0
    session = N.normalize_sessions(rows.where("class_uid = 6003")).first()
    assert (session.identity_id, session.event_name, session.event_source, session.error_code, session.is_failed) == ("sess", "GetObject", None, "Error", True)


def test_documents_and_csv(spark, tmp_path):
    for i, name in enumerate(("events", "data", "records", "Records")):
        (tmp_path / f"{i}.json").write_text(json.dumps({name: [{"time": i}]}, indent=1))
    (tmp_path / "9.json").write_text(json.dumps([{"time": 9}, {"time": 10}]))
    assert sorted(r.time for r in logs.read_document(spark, str(tmp_path), "time long").collect()) == [0, 1, 2, 3, 9, 10]
    (tmp_path / "f.csv").write_text("time,src_endpoint.ip,src_endpoint.port\n5,1.2.3.4,80\n")
    row = logs.read_flat_csv(spark, str(tmp_path / "f.csv")).first()
    assert row.src_endpoint.ip == "1.2.3.4" and row.time == "5"


def test_labels(spark):
    names = {"/x/CloudTrail_a.jsonl": "cloudtrail", "/x/vpc_b_flow.json": "vpc_flow", "s3_access.csv": "s3_access", "a/s3.json": "s3", "z/other.jsonl": "other"}
    rows = spark.createDataFrame([(k,) for k in names], "p string").select("p", logs.source_label(F.col("p")).alias("l")).collect()
    assert {r.p: r.l for r in rows} == names


def test_text_lines(spark):
    flow = "2 123456789012 eni-0a1b 10.0.0.1 10.0.0.2 1234 443 6 10 840 1534755721 1534755781 ACCEPT OK"
    access = '79a59df900b949e55d96a1e698fbacedfd6e09d98eacf8f8d5218e7cd47ef2be bkt [06/Feb/2019:00:00:38 +0000] 192.0.2.3 arn:aws:iam::1:user/bob 3E57 REST.GET.OBJECT k.txt "GET /k.txt HTTP/1.1" 200 - 2662 3462 70 10 "-" "agent 1" -'
    texts = spark.createDataFrame([(f"xx sourcetype::aws:cloudwatchlogs:vpcflow {flow}\n{flow} {flow.replace('443', '80')}",), (flow,), (f"aws:s3:accesslogs {access}",)], "value string")
    assert sorted(r.dstport for r in logs.flow_lines(texts).collect()) == ["443", "80"]
    row = logs.access_lines(texts).first()
    assert (row.bucket, row.operation, row.bytes_sent, row.user_agent) == ("bkt", "REST.GET.OBJECT", "2662", "agent 1")
    event = N.map_access(logs.access_lines(texts)).first()
    assert event.time == 1549411238000 and event.actor.user.name == "bob" and event.activity_id == 2 and event.status_id == 1 and event.http_request.url.path == "/k.txt" and event.api.response.code == 200 and event.api.response.error is None
    net = N.map_flow(logs.flow_lines(texts).where("dstport = '80'")).first()
    assert net.time == 1534755721000 and net.dst_endpoint.port == 80 and net.traffic.bytes == 840 and net.type_uid == 400106 and net.status_id == 1
    inventory = {(r.bucket, r.name): r.n for r in logs.source_inventory(spark.createDataFrame([("a", "sourcetype::x sourcetype::x sourcetype::y"), ("b", "sourcetype::x")], "b string, v string"), "v", "b", keep=1).collect()}
    assert inventory == {("a", "x"): 2, ("b", "x"): 1, (None, "x"): 3, (None, "y"): 1}


def test_shapes(spark):
    texts = ['{"eventVersion":1,"eventSource":2,"eventName":3,"z":0}', '{"schemaVersion":1,"type":2,"accountId":3,"region":4}', json.dumps({k: 1 for k in logs.SHAPES["vpcflow"]}), '{"a":1}', "[1]", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", logs.record_shape(F.col("t")).alias("s")).orderBy("i").collect()
    assert [r.s for r in rows] == ["cloudtrail", "guardduty", "vpcflow", None, None, None]


def audit(spark, **fields):
    base = {"eventTime": "2018-08-20T09:00:00Z", "eventName": "RunInstances", "sourceIPAddress": "10.0.0.1", "userIdentity": {"type": "IAMUser", "userName": "al"}}
    return spark.read.schema(N.AUDIT_SCHEMA).json(spark.createDataFrame([(json.dumps(base | fields),)], "value string").rdd.map(lambda r: r[0]))


@pytest.mark.parametrize("who, name, system", [
    ({"type": "IAMUser", "userName": "al"}, "al", False), ({"type": "AWSService"}, "AWSService", True), ({"type": "Root"}, "Root", False),
    ({"type": "AssumedRole", "sessionContext": {"sessionIssuer": {"userName": "dev", "arn": "arn:x/y"}}}, "dev", False), ({"type": "AssumedRole", "sessionContext": {"sessionIssuer": {"arn": "arn:aws:iam::1:role/my-lambda"}}}, "my-lambda", False),
    ({"type": "AssumedRole", "arn": "arn:aws:sts::1:assumed-role/web/i-0123456789abcdef0"}, "web", True), ({"type": "AssumedRole", "sessionContext": {"sessionIssuer": {"userName": "AWSServiceRoleForX"}}}, "AWSServiceRoleForX", True),
    ({"type": "AssumedRole", "sessionContext": {"sessionIssuer": {"userName": "a-lambda-b"}}}, "a-lambda-b", True),
])
def test_identities(spark, who, name, system):
    row = N.map_audit(audit(spark, userIdentity=who)).first()
    assert row.actor.user.name == name and row.unmapped.is_system_actor is system


def test_audit_resources(spark):
    request = {"bucketName": "b", "instancesSet": {"items": [{"imageId": "ami-1"}, {"imageId": "ami-2"}]}, "resourcesSet": {"items": [{"resourceId": "vol-1"}]}, "roleArn": "arn:aws:iam::1:role/r1", "encryptionContext": {"a": "arn:aws:lambda:x:function:f", "b": "no"}, "configRuleNames": ["c1", "b"]}
    names = lambda **f: [r.name for r in N.map_audit(audit(spark, **f)).first().resources]
    assert names(requestParameters=request) == ["b", "vol-1", "r1", "f", "c1", "ami-1"]
    assert names(requestParameters={}, responseElements={"instancesSet": {"items": [{"instanceId": "i-1"}, {"instanceId": "i-1"}]}}) == ["i-1"]
    row = N.map_audit(audit(spark, sourceIPAddress="autoscaling.amazonaws.com", errorCode="AccessDenied", eventTime="bad")).first()
    assert row.src_endpoint.ip is None and row.src_endpoint.svc_name and row.status_id == 2 and row.time is None and row.api.response.error == "AccessDenied" and row.resources == []
    raw = N.normalize_sessions(audit(spark)).first()
    assert raw.identity_id == "unknown" and raw.action_category == "ComputeChange"


@pytest.mark.parametrize("name, want", [(None, 0), ("", 0), ("CreateUser", 1), ("putObject", 1), ("HeadObject", 2), ("SetX", 3), ("StopLogging", 4), ("Zap", 99)])
def test_crud(spark, name, want):
    assert spark.createDataFrame([(name,)], "n string").select(X.crud_class("n").alias("c")).first().c == want


def test_fields_of_the_detector(spark):
    rows = spark.read.json(spark.createDataFrame([(json.dumps(x),) for x in (
        {"id": 1, "time": 1534755721000, "cloud": {"account": {"uid": "77"}}, "actor": {"user": {"uid": None, "name": "bob"}}, "src_endpoint": {"ip": "1.1.1.1", "interface_uid": "eni-1"}, "dst_endpoint": {"ip": "9.9.9.9", "port": 443}, "traffic": {"bytes": 12}, "resources": [{"name": "r1"}, {"name": ""}]},
        {"id": 2, "time": 1534755721, "src_endpoint": {"interface_uid": "eni-2"}, "dst_endpoint": {"ip": "9.9.9.9"}}, {"id": 3, "time": 1534755721000000, "src_endpoint": {"ip": "2.2.2.2"}, "cloud": {"account": {"uid": "77"}}}, {"id": 4},
    )], "value string").rdd.map(lambda r: r[0]))
    got = N.exfil_events(rows).orderBy("event_uid").collect()
    assert [r.entity_key for r in got] == ["principal:77:bob", "interface:unknown_account:eni-2", "host:77:2.2.2.2"] and len({r.event_time for r in got}) == 1
    assert got[0].destination == "9.9.9.9:443" and got[1].destination == "9.9.9.9" and got[2].destination == "unknown_destination" and got[0].bytes_out == 12 and got[1].bytes_out == 0 and got[0].resource == "r1" and got[1].resource == "unknown"


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("x", 1.0, None, [1], "2024-01-01")], "principal string, risk_score double, nothing string, list array<int>, day string")
    logs.write_csv(logs.alert_columns(rows), str(tmp_path / "a"))
    assert spark.read.option("header", True).csv(str(tmp_path / "a")).columns == ["risk_score", "principal", "nothing", "list", "day"]
    logs.write_events(rows, str(tmp_path / "e"))
    assert "nothing" not in spark.read.text(str(tmp_path / "e")).first().value
    logs.write_table(rows, str(tmp_path / "t"), ["day"])
    assert logs.read_results(spark, str(tmp_path / "t"), ("2024-01-01", "2024-01-02")).count() == 1
    valid = N.conformance(spark.createDataFrame([("f", 1, None), ("f", None, 2)], "file string, a int, b int"), ["a", "c"], ["file"]).first()
    assert (valid.total, valid.valid, valid.errors) == (2, 0, ["a: missing, c: missing", "c: missing"])
    timeline = N.actor_timeline(spark.createDataFrame([(1,)], "x int").withColumn("event_time", F.current_timestamp()), F.lit("u")).first()
    assert timeline.n == 1


def test_numbered_and_bad_lines(spark, tmp_path):
    good = json.dumps(EVENT)
    (tmp_path / "a.jsonl").write_text("\n".join([good] * 400 + ["", "not json"] + [good] * 300 + ["[1]"]) + "\n")
    (tmp_path / "b.jsonl").write_text(f"{good}\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10k")  # several blocks a file
    try:
        rows = logs.numbered_lines(spark, str(tmp_path)).collect()
        assert sorted(r.line_number for r in rows if r.input_file.endswith("a.jsonl")) == list(range(1, 704))
        assert [(r.input_file[-7:], r.line_number) for r in logs.bad_lines(spark, str(tmp_path)).orderBy("line_number").collect()] == [("a.jsonl", 402), ("a.jsonl", 703)]
        with pytest.raises(ValueError, match="a.jsonl, line 402"):
            logs.check_lines(spark, str(tmp_path))
        logs.check_lines(spark, str(tmp_path / "b.jsonl"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_expanding_sources(spark, tmp_path):
    deep = tmp_path / "x" / "y"
    deep.mkdir(parents=True)
    (deep / "a.jsonl").write_text(json.dumps({"time": 1, "src_endpoint": {"ip": "1.1.1.1"}}) + "\n")
    (deep / "b.ndjson").write_text(json.dumps({"time": 2}) + "\n")
    (tmp_path / "c.json").write_text(json.dumps({"records": [{"time": 3}, {"time": 4}]}))
    (tmp_path / "d.csv").write_text("time,src_endpoint.ip\n5,5.5.5.5\n")
    (tmp_path / "e.txt").write_text("no")
    inputs = [str(tmp_path), str(deep), str(deep / "*.jsonl")]
    assert {k: len(v) for k, v in logs.expand_sources(spark, inputs).items()} == {"jsonl": 1, "ndjson": 1, "json": 1, "csv": 1}
    rows = logs.read_sources(spark, inputs, "time long, src_endpoint struct<ip:string>").collect()
    assert sorted((r.time, r.src_endpoint.ip if r.src_endpoint else None) for r in rows) == [(1, "1.1.1.1"), (2, None), (3, None), (4, None), (5, "5.5.5.5")]
    with pytest.raises(FileNotFoundError):
        logs.expand_sources(spark, [str(tmp_path / "e.txt"), str(tmp_path / "none*")])


def test_ties_do_not_depend_on_partitions(spark):
    rows = [(6003, 1534755721000, ("a",), (f"Op{i}",)) for i in range(30)]
    events = spark.createDataFrame(rows, "class_uid int, time long, user struct<name:string>, api struct<operation:string>")
    events = events.select("class_uid", "time", F.struct("user").alias("actor"), "api")
    order = lambda f: [r.event_name for r in N.session_events(f).orderBy("event_time", "event_uid").collect()]
    assert order(events.repartition(5)) == order(events.coalesce(1))


def test_stripping(spark, tmp_path):
    """Every depth: null fields, empty lists and maps and structs without values go; null elements leave lists; empty texts and empty objects in lists stay."""
    schema = "i int, a struct<b:struct<c:string>,d:string>, l array<struct<x:int>>, m map<string,string>, n array<array<int>>, `p.q` string"
    rows = [
        (1, ((None,), None), [], {}, [[]], None), (2, (("",), None), [None, (None,)], {"k": None}, [[None, 3], None], "z"),
        (3, None, None, None, None, None), (4, ((None,), "d"), [(5,)], {"k": "v", "l": None}, [], ""),
    ]
    logs.write_events(logs.strip_empty(spark.createDataFrame(rows, schema)), str(tmp_path / "e"))
    got = sorted((json.loads(r.value) for r in spark.read.text(str(tmp_path / "e")).collect()), key=lambda r: r["i"])
    assert got == [
        {"i": 1, "n": [[]]}, {"i": 2, "a": {"b": {"c": ""}}, "l": [{}], "n": [[3]], "p.q": "z"}, {"i": 3}, {"i": 4, "a": {"d": "d"}, "l": [{"x": 5}], "m": {"k": "v"}, "p.q": ""},
    ]


def test_roots_and_sources_named_twice(spark, tmp_path):
    for folder in ("a", "a-b", "a/c"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "x.jsonl").write_text(json.dumps({"time": len(folder)}) + "\n")
        (tmp_path / folder / "y.json").write_text(json.dumps([{"time": 10 + len(folder)}]))
        (tmp_path / folder / "z.csv").write_text(f"time\n{20 + len(folder)}\n")
        (tmp_path / folder / "part-0.json").write_text(json.dumps({"time": 30 + len(folder)}) + "\n" + json.dumps({"time": 40 + len(folder)}) + "\n")
    named = [f"{tmp_path}/a", f"{tmp_path}/a*", f"{tmp_path}/a/c/x.jsonl", f"{tmp_path}/none*"]
    assert [r.rsplit("/", 1)[1] for r in logs.source_roots(spark, named)] == ["a", "a-b"]
    times = [1, 3, 3, 11, 13, 13, 21, 23, 23, 31, 33, 33, 41, 43, 43]
    assert sorted(r.time for r in logs.read_sources(spark, named, "time long").collect()) == times
    with pytest.raises(FileNotFoundError):
        logs.read_sources(spark, f"{tmp_path}/none*")


def test_lines_written_by_day_are_read_back(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2024-01-05"), (2, "2024-01-06")], "time long, day string")
    logs.write_events(rows, str(tmp_path / "e"), by=["day"])
    assert [(r.time, str(r.day)) for r in logs.read_events(spark, f"{tmp_path}/e/day=2024-01-06", strict=True).collect()] == [(2, "2024-01-06")]
