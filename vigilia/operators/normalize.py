"""Raw records to events: identity, resources, classes and the fields detectors read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from vigilia.functions import exprs as X
from vigilia.functions import fixed

# Times.


def iso_millis(text: Column) -> Column:
    """Epoch milliseconds of `2018-08-20T09:00:00Z`; null if malformed."""
    return F.unix_millis(F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'")))


def access_log_millis(text: Column) -> Column:
    """Epoch milliseconds of `20/Aug/2018:09:00:00 +0000`; null if malformed."""
    return F.unix_millis(F.try_to_timestamp(text, F.lit("dd/MMM/yyyy:HH:mm:ss Z")))


def any_epoch(value: Column) -> Column:
    """A timestamp from seconds, milliseconds or microseconds, told apart per row by magnitude, or from ISO text; null if it is none."""
    number = value.cast("string").try_cast("double")
    micros = F.when(F.abs(number) >= 1e14, number).when(F.abs(number) >= 1e11, number * 1e3).otherwise(number * 1e6)
    return F.coalesce(F.timestamp_micros(micros.cast("long")), F.try_to_timestamp(value.cast("string")))


# Fields.


def has_path(schema: T.StructType, path: str) -> bool:
    kind: T.DataType = schema
    for part in path.split("."):
        if not isinstance(kind, T.StructType) or part not in kind.names:
            return False
        kind = kind[part].dataType
    return True


def coalesce_paths(frame: DataFrame, paths: list[str], default: str | None = None) -> Column:
    """The first non-null of the paths that the frame's schema has, else the default."""
    found = [F.col(p).cast("string") for p in paths if has_path(frame.schema, p)]
    return F.coalesce(*found, F.lit(default).cast("string"))


def event_uid(events: DataFrame) -> Column:
    """What breaks ties in time: the event's own uid, else a hash of the whole event, so that it does not depend on how rows are dealt."""
    own = [F.col(p).cast("string") for p in ("metadata.uid", "eventID") if has_path(events.schema, p)]
    return F.coalesce(*(X.empty_to_null(c) for c in own), F.concat(F.lit("#"), F.hex(F.xxhash64(F.to_json(F.struct("*"))))))


def number(value: Column) -> Column:
    return F.coalesce(value.cast("string").try_cast("double"), F.lit(0.0))


def entity(account: Column, principal: Column, src_uid: Column, interface_uid: Column, src_ip: Column) -> Column:
    """struct(entity_key, entity_type): principal before endpoint, interface and host; with an account first."""
    key = lambda kind, a, v: F.struct(F.concat_ws(":", F.lit(kind), a, v).alias("entity_key"), F.lit(kind).alias("entity_type"))
    some = X.is_meaningful
    nobody = F.lit("unknown_account")
    out = F.when(some(account) & some(principal), key("principal", account, principal)).when(some(principal), key("principal", nobody, principal))
    for has, owner in ((some(account), account), (F.lit(True), nobody)):
        for kind, value in (("endpoint", src_uid), ("interface", interface_uid), ("host", src_ip)):
            out = out.when(has & some(value), key(kind, owner, value))
    return out.otherwise(F.struct(F.lit("unknown_entity").alias("entity_key"), F.lit("unknown").alias("entity_type")))


def destination(domain: Column, ip: Column, port: Column) -> Column:
    place = F.coalesce(domain, ip, F.lit("unknown_destination"))
    return F.when(X.is_meaningful(port), F.concat_ws(":", place, port.cast("string"))).otherwise(place)


def resource_label(label: Column, resources: Column | None) -> Column:
    """The label if there is one, else the name, uid or type of each resource joined by `|`, else `unknown`."""
    own = F.when(F.trim(label) != "", label)
    if resources is None:
        return F.coalesce(own, F.lit("unknown"))
    names = F.filter(F.transform(resources, lambda r: F.coalesce(X.empty_to_null(r["name"]), X.empty_to_null(r["uid"]), X.empty_to_null(r["type"]))), lambda n: n.isNotNull())
    return F.coalesce(own, F.when(F.size(names) > 0, F.array_join(names, "|")), F.lit("unknown"))


def exfil_events(events: DataFrame, bytes_paths: list[str] | None = None, label: Column | None = None) -> DataFrame:
    """Events of any shape to the fields of the exfiltration detector; rows without a time are dropped.

    Only paths which the schema has are read. `bytes_paths` replaces where
    outgoing bytes are looked for.
    """
    paths = fixed.FIELD_PATHS
    get = lambda name, default=None: coalesce_paths(events, paths[name], default)
    resources = F.col("resources") if has_path(events.schema, "resources") else None
    if resources is not None:
        inner = events.schema["resources"].dataType.elementType.names
        resources = F.transform(resources, lambda r: F.struct(*(r[n].cast("string").alias(n) if n in inner else F.lit(None).cast("string").alias(n) for n in ("name", "uid", "type"))))
    out = events.select(
        (label if label is not None else coalesce_paths(events, ["log_source", "metadata.log_name", "metadata.product.name", "metadata.product.feature.name", "metadata.source", "class_name"], "unknown_source")).alias("log_source"),
        any_epoch(get("time")).alias("event_time"), get("account", "unknown_account").alias("cloud_account"), get("principal", "unknown_principal").alias("principal"),
        get("src_ip", "unknown_src").alias("src_ip"), get("src_uid", "unknown_src_uid").alias("src_uid"), get("interface_uid", "unknown_interface").alias("interface_uid"),
        destination(get("dst_domain"), get("dst_ip"), get("dst_port")).alias("destination"), get("protocol").alias("protocol"),
        number(coalesce_paths(events, bytes_paths or paths["bytes_out"])).alias("bytes_out"), number(get("bytes_in")).alias("bytes_in"),
        get("api_operation", "unknown_operation").alias("api_operation"), get("api_service", "unknown_service").alias("api_service"), get("user_agent", "unknown_user_agent").alias("user_agent"),
        resource_label(get("resource"), resources).alias("resource"), event_uid(events).alias("event_uid"),
    ).where("event_time IS NOT NULL")
    who = entity(F.col("cloud_account"), F.col("principal"), F.col("src_uid"), F.col("interface_uid"), F.col("src_ip"))
    return out.withColumn("_e", who).select("*", "_e.entity_key", "_e.entity_type").drop("_e")


# Session events.


def session_identity(uid_alt: Column, name: Column, uid: Column) -> Column:
    return F.coalesce(F.when(uid_alt.startswith("arn:"), X.tail(uid_alt)), X.empty_to_null(name), X.empty_to_null(uid), F.lit("unknown"))


def session_events(events: DataFrame) -> DataFrame:
    """Event structs to the fields sessions read; rows without time, identity or name are dropped. A status other than 1 is an error."""
    has = lambda p: has_path(events.schema, p)
    get = lambda p, kind="string": F.col(p).cast(kind) if has(p) else F.lit(None).cast(kind)
    operation = get("api.operation")
    name = F.when(operation.isin(fixed.GETOBJECT_OPERATIONS), "GetObject").otherwise(operation)
    status = get("status_id", "int")
    error = F.when(status.isNotNull() & (status != 1), F.coalesce(X.empty_to_null(get("status_detail")), X.empty_to_null(get("status")), F.lit("Error")))
    out = events.select(
        F.timestamp_millis(F.nullif(get("time", "long"), F.lit(0).cast("long"))).alias("event_time"), event_uid(events).alias("event_uid"), name.alias("event_name"),
        F.coalesce(X.empty_to_null(get("api.service.name")), X.lookup(fixed.service_map(), operation)).alias("event_source"),
        session_identity(get("actor.user.uid_alt"), get("actor.user.name"), get("actor.user.uid")).alias("identity_id"), get("actor.user.type").alias("identity_type"),
        get("src_endpoint.ip").alias("source_ip"), get("cloud.region").alias("aws_region"), get("http_request.user_agent").alias("user_agent"), get("cloud.account.uid").alias("account_id"), error.alias("error_code"),
    )
    return finish_session_events(out)


def session_events_from_audit(records: DataFrame) -> DataFrame:
    """Raw audit records (fields of the audit trail, `userIdentity` a struct) to the same fields."""
    get = lambda p: F.col(p).cast("string") if has_path(records.schema, p) else F.lit(None).cast("string")
    out = records.select(
        F.try_to_timestamp(get("eventTime")).alias("event_time"), event_uid(records).alias("event_uid"), get("eventName").alias("event_name"), get("eventSource").alias("event_source"),
        F.coalesce(X.empty_to_null(get("userIdentity.arn")), X.empty_to_null(get("userIdentity.principalId")), F.lit("unknown")).alias("identity_id"), get("userIdentity.type").alias("identity_type"),
        get("sourceIPAddress").alias("source_ip"), get("awsRegion").alias("aws_region"), get("userAgent").alias("user_agent"),
        F.coalesce(X.empty_to_null(get("userIdentity.accountId")), get("recipientAccountId")).alias("account_id"), get("errorCode").alias("error_code"),
    )
    return finish_session_events(out)


def normalize_sessions(records: DataFrame) -> DataFrame:
    """Either shape, told by the schema: event structs have `class_uid` or `api.operation`."""
    shaped = has_path(records.schema, "class_uid") or has_path(records.schema, "api.operation")
    return session_events(records) if shaped else session_events_from_audit(records)


def finish_session_events(rows: DataFrame) -> DataFrame:
    return rows.dropna(subset=["event_time", "identity_id", "event_name"]).withColumns({
        "action_category": X.action_category("event_name"), "is_sensitive": X.is_sensitive("event_name"), "is_failed": F.coalesce(F.length("error_code") > 0, F.lit(False)),
    })


def timeline_actor(events: DataFrame) -> Column:
    get = lambda p: X.empty_to_null(F.col(p)) if has_path(events.schema, p) else F.lit(None).cast("string")
    return F.coalesce(get("actor.user.name"), get("actor.user.uid_alt"), get("actor.user.uid"), F.lit("UNKNOWN"))


def actor_timeline(events: DataFrame, actor: Column) -> DataFrame:
    """(actor, n, first_seen, last_seen), most active first."""
    return events.groupBy(actor.alias("actor")).agg(F.count("*").alias("n"), F.min("event_time").alias("first_seen"), F.max("event_time").alias("last_seen")).orderBy(F.desc("n"), "actor")


# Raw records to event structs. Free-form parts stay JSON text.


def audit_is_system(identity: Column) -> Column:
    role = F.coalesce(identity["sessionContext"]["sessionIssuer"]["userName"], F.lit(""))
    arn = F.coalesce(identity["arn"], F.lit(""))
    by_name = role.isin(fixed.SYSTEM_ROLES)
    for prefix in fixed.SYSTEM_ROLE_PREFIXES:
        by_name = by_name | role.startswith(prefix)
    for part in fixed.SYSTEM_ROLE_PARTS:
        by_name = by_name | role.contains(part)
    session = F.when(arn.contains("/"), X.tail(arn)).otherwise(F.lit(""))
    return F.coalesce(identity["type"] == "AWSService", F.lit(False)) | (F.coalesce(identity["type"] == "AssumedRole", F.lit(False)) & (by_name | X.is_instance_id(session)))


def audit_user_name(identity: Column) -> Column:
    """userName; for an assumed role its issuer's name, the tail of the issuer's ARN, or the role in the session's ARN; else the type."""
    issuer = identity["sessionContext"]["sessionIssuer"]
    role = F.coalesce(X.empty_to_null(issuer["userName"]), X.tail(X.empty_to_null(issuer["arn"])), F.when(identity["arn"].contains("assumed-role/"), F.regexp_extract(identity["arn"], r"assumed-role/([^/]*)", 1)))
    return F.coalesce(X.empty_to_null(identity["userName"]), F.when(identity["type"] == "AssumedRole", role), X.empty_to_null(identity["type"]))


def audit_resources(operation: Column, request: Column, response: Column) -> Column:
    """Names in requests and responses (JSON texts), each once, in the order found; for a launch without instance ids the first image."""
    items = "array<struct<instanceId:string,resourceId:string,imageId:string>>"
    get = lambda j, path: X.empty_to_null(F.get_json_object(j, path))
    listed = lambda j, path: F.coalesce(F.from_json(F.get_json_object(j, path), items), F.array().cast(items))
    pick = lambda a, field: F.transform(a, lambda x: x[field])
    one = lambda c: F.when(c.isNotNull(), F.array(c)).otherwise(F.array().cast("array<string>"))
    launched = listed(request, "$.instancesSet.items")
    context = F.map_values(F.from_json(F.coalesce(F.get_json_object(request, "$.encryptionContext"), F.lit("{}")), "map<string,string>"))
    arns = F.transform(F.filter(context, lambda v: v.startswith("arn:aws:")), lambda v: F.when(v.contains("/"), X.tail(v)).otherwise(X.tail(v, ":")))
    rules = F.coalesce(F.from_json(F.get_json_object(request, "$.configRuleNames"), "array<string>"), F.array().cast("array<string>"))
    found = F.concat(
        one(get(request, "$.bucketName")), pick(launched, "instanceId"), pick(listed(response, "$.instancesSet.items"), "instanceId"), pick(listed(request, "$.resourcesSet.items"), "resourceId"),
        one(X.tail(get(request, "$.roleArn"))), arns, rules,
    )
    found = F.filter(found, lambda n: n.isNotNull() & (n != ""))
    image = F.slice(F.filter(pick(launched, "imageId"), lambda n: n.isNotNull() & (n != "")), 1, 1)
    bare = (operation == "RunInstances") & ~F.exists(found, lambda n: n.startswith("i-"))
    return F.array_distinct(F.when(F.coalesce(bare, F.lit(False)), F.concat(found, image)).otherwise(found))


AUDIT_SCHEMA = (
    "eventTime string, eventName string, eventSource string, eventType string, eventID string, eventVersion string, awsRegion string, sourceIPAddress string, userAgent string, requestID string, "
    "recipientAccountId string, errorCode string, errorMessage string, userIdentity struct<type:string,userName:string,principalId:string,arn:string,accountId:string,accessKeyId:string,"
    "sessionContext:struct<sessionIssuer:struct<userName:string,arn:string>>>, requestParameters string, responseElements string, additionalEventData string"
)
ACCESS_FIELDS = [
    "bucket_owner", "bucket", "timestamp", "remote_ip", "requester", "request_id", "operation", "key", "request_uri", "http_status", "error_code", "bytes_sent", "object_size", "total_time",
    "turnaround_time", "referer", "user_agent", "version_id",
]
FLOW_FIELDS = ["version", "account_id", "interface_id", "srcaddr", "dstaddr", "srcport", "dstport", "protocol", "packets", "bytes", "start", "end", "action", "log_status"]


def _event(columns: dict[str, Column], class_uid: int, activity: Column) -> list[Column]:
    names = {6003: ("Application Activity", "API Activity"), 4001: ("Network Activity", "Network Activity")}[class_uid]
    head = {
        "category_uid": F.lit(class_uid // 1000), "category_name": F.lit(names[0]), "class_uid": F.lit(class_uid), "class_name": F.lit(names[1]),
        "activity_id": activity, "type_uid": F.lit(class_uid * 100) + activity,
    }
    return [c.alias(n) for n, c in (head | columns).items()]


def _struct(**fields: Column) -> Column:
    return F.struct(*(c.alias(n) for n, c in fields.items()))


def map_audit(records: DataFrame) -> DataFrame:
    """Audit records of AUDIT_SCHEMA to event structs."""
    c, who = F.col, F.col("userIdentity")
    failed = F.coalesce(c("errorCode") != "", F.lit(False))
    ip = X.is_ip("sourceIPAddress")
    return records.select(*_event({
        "severity_id": F.when(failed, 2).otherwise(1), "status_id": F.when(failed, 2).otherwise(1), "time": iso_millis(c("eventTime")),
        "metadata": _struct(product=_struct(name=F.lit("CloudTrail"), vendor_name=F.lit("AWS")), version=F.lit("1.1.0"), event_code=c("eventType"), uid=c("eventID")),
        "cloud": _struct(provider=F.lit("AWS"), region=c("awsRegion"), account=_struct(uid=F.coalesce(X.empty_to_null(who["accountId"]), c("recipientAccountId")))),
        "actor": _struct(user=_struct(type=who["type"], name=audit_user_name(who), uid=who["principalId"], uid_alt=who["accessKeyId"], account=_struct(uid=X.empty_to_null(who["accountId"])))),
        "api": _struct(operation=c("eventName"), service=_struct(name=c("eventSource")), request=_struct(uid=c("requestID")), response=_struct(error=F.when(failed, c("errorCode")), message=F.when(failed, c("errorMessage")))),
        "src_endpoint": _struct(ip=F.when(ip, c("sourceIPAddress")), svc_name=F.when(~ip, c("sourceIPAddress"))), "http_request": _struct(user_agent=c("userAgent")),
        "resources": F.transform(audit_resources(c("eventName"), c("requestParameters"), c("responseElements")), lambda n: F.struct(n.alias("name"))),
        "unmapped": _struct(raw_eventVersion=c("eventVersion"), requestParameters=c("requestParameters"), responseElements=c("responseElements"), additionalEventData=c("additionalEventData"), is_system_actor=audit_is_system(who)),
    }, 6003, X.crud_class("eventName")))


def map_access(records: DataFrame) -> DataFrame:
    """Access-log records of ACCESS_FIELDS (all texts) to event structs."""
    c = F.col
    requester, agent = F.coalesce("requester", F.lit("")), F.coalesce("user_agent", F.lit(""))
    arn = requester.startswith("arn:")
    delivery = ~arn & agent.startswith("aws-internal/")
    name = F.when(delivery, "s3-log-delivery").when(arn, X.tail(requester))
    failed = F.coalesce((c("http_status") != "") & ~c("http_status").startswith("2"), F.lit(False))
    verb = F.split(F.replace("operation", F.lit("REST."), F.lit("")), r"\.")[0]
    request = F.split("request_uri", " ")
    return records.select(*_event({
        "severity_id": F.when(failed, 2).otherwise(1), "status_id": F.when(failed, 2).otherwise(1), "time": access_log_millis(c("timestamp")),
        "metadata": _struct(product=_struct(name=F.lit("Amazon S3"), vendor_name=F.lit("AWS")), version=F.lit("1.1.0"), uid=c("request_id")), "cloud": _struct(provider=F.lit("AWS")),
        "actor": _struct(user=_struct(uid=F.when(~arn, requester), uid_alt=F.when(arn, requester), name=name)),
        "api": _struct(operation=c("operation"), service=_struct(name=F.lit("s3.amazonaws.com")), request=_struct(uid=c("request_id")), response=_struct(code=c("http_status").try_cast("int"), error=F.when(c("error_code") != "-", c("error_code")))),
        "src_endpoint": _struct(ip=c("remote_ip")), "resources": F.array(_struct(name=c("bucket"), type=F.lit("bucket"), data=_struct(key=c("key")))),
        "http_request": _struct(http_method=X.empty_to_null(F.get(request, F.lit(0))), url=_struct(path=F.get(request, F.lit(1))), user_agent=c("user_agent")),
        "unmapped": _struct(**{n: c(n) for n in ("bucket_owner", "object_size", "bytes_sent", "total_time", "turnaround_time", "version_id", "referer")}, is_system_actor=delivery | X.is_instance_id(name)),
    }, 6003, X.crud_class(verb)))


def map_flow(records: DataFrame) -> DataFrame:
    """Flow records of FLOW_FIELDS (all texts, times in seconds) to event structs."""
    c = F.col
    whole = lambda n: c(n).try_cast("long")
    millis = lambda n: F.nullif(whole(n), F.lit(0).cast("long")) * 1000
    return records.select(*_event({
        "severity_id": F.lit(1), "status_id": F.when(c("action") == "ACCEPT", 1).otherwise(2), "time": millis("start"), "start_time": millis("start"), "end_time": millis("end"),
        "metadata": _struct(product=_struct(name=F.lit("VPC Flow Logs"), vendor_name=F.lit("AWS"), version=c("version")), version=F.lit("1.1.0")),
        "cloud": _struct(provider=F.lit("AWS"), account=_struct(uid=c("account_id"))), "src_endpoint": _struct(ip=c("srcaddr"), port=whole("srcport").cast("int"), interface_uid=c("interface_id")),
        "dst_endpoint": _struct(ip=c("dstaddr"), port=whole("dstport").cast("int")), "connection_info": _struct(protocol_num=whole("protocol").cast("int"), direction_id=F.lit(0)),
        "traffic": _struct(packets=whole("packets"), bytes=whole("bytes")), "unmapped": _struct(log_status=c("log_status"), action=F.coalesce("action", F.lit("")), is_system_actor=F.lit(False)),
    }, 4001, F.lit(6)))


def map_counts(records: DataFrame, events: DataFrame, by: str) -> DataFrame:
    """(by, read, mapped, skipped) of raw records and the events they were mapped to: an event without a time is an error and is skipped."""
    read = records.groupBy(by).agg(F.count("*").alias("read"))
    good = events.where("time IS NOT NULL").groupBy(by).agg(F.count("*").alias("mapped"))
    out = read.join(good, by, "left").na.fill(0, ["mapped"])
    return out.withColumn("skipped", F.col("read") - F.col("mapped"))


def conformance(events: DataFrame, required: list[str], by: list[str], types: dict[str, str] | None = None, order: list[str] | None = None, keep: int = 5) -> DataFrame:
    """(by, total, valid, errors): how many records have the required paths and, where a path has one of `types`, a value of that type.

    errors are the texts of each group's first `keep` records with an error, in
    the given order, else in that of their texts; a record's errors stand in one text.
    """
    types = types or {}

    def fault(path: str) -> Column:
        if not has_path(events.schema, path):
            return F.lit(f"{path}: missing") if path in required else F.lit(None).cast("string")
        value = F.col(path)
        text = F.when(value.isNull(), F.lit(f"{path}: missing") if path in required else F.lit(None))
        return text.when(value.cast("string").try_cast(types[path]).isNull(), f"{path}: no {types[path]}") if path in types else text

    rows = events.withColumn("_errors", X.compact(*(fault(p) for p in dict.fromkeys([*required, *types])))).withColumn("_text", F.array_join("_errors", ", "))
    counts = rows.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(F.size("_errors") == 0).alias("valid"))
    turn = W.partitionBy(*by).orderBy(*(order or []), "_text")
    first = rows.where(F.size("_errors") > 0).withColumn("_place", F.row_number().over(turn)).where(F.col("_place") <= keep)
    texts = first.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_place", "_text"))).alias("_e")).select(*by, F.col("_e._text").alias("errors"))
    return counts.join(texts, by, "left").withColumn("errors", F.coalesce("errors", F.array().cast("array<string>")))
