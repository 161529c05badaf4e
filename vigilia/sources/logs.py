"""Reading logs of the supported shapes, parsing raw text lines, and writing results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from vigilia.functions import exprs as X
from vigilia.operators.normalize import ACCESS_FIELDS, FLOW_FIELDS, has_path

#: Fixed value: the event contract all sources share, as a superset; missing paths are null.
EVENT = (
    "category_uid int, category_name string, class_uid int, class_name string, activity_id int, type_uid int, severity_id int, status_id int, time long, start_time long, end_time long, "
    "metadata struct<product:struct<name:string,vendor_name:string,version:string>,version:string,event_code:string,uid:string>, "
    "cloud struct<provider:string,region:string,account:struct<uid:string>>, "
    "actor struct<user:struct<type:string,name:string,uid:string,uid_alt:string,account:struct<uid:string>>>, "
    "api struct<operation:string,service:struct<name:string>,request:struct<uid:string>,response:struct<code:int,error:string,message:string>>, "
    "src_endpoint struct<ip:string,svc_name:string,port:int,interface_uid:string>, dst_endpoint struct<ip:string,port:int>, connection_info struct<protocol_num:int,direction_id:int>, "
    "traffic struct<bytes:long,packets:long>, resources array<struct<name:string,type:string,data:struct<key:string>>>, "
    "http_request struct<user_agent:string,http_method:string,url:struct<path:string>>, "
    "unmapped struct<is_system_actor:boolean,bytes_sent:string,object_size:string,total_time:string,action:string,log_status:string,requestParameters:string,responseElements:string,additionalEventData:string>"
)
SUFFIXES = ["jsonl", "ndjson", "json", "csv"]
LINES = "{*.jsonl,*.ndjson,part-*.json}"  # files of JSON lines; the last are those that write_events leaves


def source_label(path: Column) -> Column:
    """A source's name from a file's: audit trail, flow log, object access; else the file name without its suffix."""
    name = F.lower(X.tail(path))
    s3 = name.contains("s3")
    return (
        F.when(name.contains("cloudtrail"), "cloudtrail").when(name.contains("vpc") & name.contains("flow"), "vpc_flow")
        .when(s3 & (name.contains("access") | name.contains("server")), "s3_access").when(s3, "s3").otherwise(F.regexp_replace(X.tail(path), r"\.[^.]*$", ""))
    )


def day_of(path: Column) -> Column:
    """The day of a file in a `<yyyy-mm-dd>` or `day=<yyyy-mm-dd>` folder."""
    return F.to_date(F.nullif(F.regexp_extract(path, r"/(?:day=)?(\d{4}-\d{2}-\d{2})/", 1), F.lit("")))


def _present(spark: SparkSession, paths: list[str]) -> list[str]:
    """The paths and globs that match something, asked of the store that holds them."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        found = place.getFileSystem(conf).globStatus(place)
        if found is not None and len(found):
            out.append(path)
    return out


def read_events(spark: SparkSession, paths: list[str] | str, schema: str = EVENT, strict: bool = False, optional: bool = False) -> DataFrame:
    """JSON lines of events under files, folders or globs, with input_file, source and day.

    Blank lines are skipped. A bad line fails the read if `strict`, else its
    text is in _corrupt_record. Nothing found is an error, or an empty frame
    if `optional`.
    """
    wanted = [paths] if isinstance(paths, str) else paths
    found = _present(spark, wanted)
    if not found and not optional:
        raise FileNotFoundError(f"no input under {wanted}")
    if not found:
        return spark.createDataFrame([], f"{schema}, input_file string, source string, day date")
    reader = spark.read.schema(schema if strict else f"{schema}, _corrupt_record string").option("mode", "FAILFAST" if strict else "PERMISSIVE").option("recursiveFileLookup", True)
    rows = reader.option("pathGlobFilter", LINES).json(found)
    return rows.withColumn("input_file", F.col("_metadata.file_path")).withColumns({"source": source_label(F.col("input_file")), "day": day_of(F.col("input_file"))})


def numbered_lines(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(input_file, line_number, value) of text files, numbered from 1 in each file: lines are counted per block, and blocks stand one after another."""
    lines = spark.read.option("recursiveFileLookup", True).text(paths)
    rows = lines.select(F.input_file_name().alias("input_file"), F.input_file_block_start().alias("_block"), F.monotonically_increasing_id().alias("_id"), "value")
    ends = rows.groupBy("input_file", "_block").agg(F.count("*").alias("_n"), F.min("_id").alias("_least"))
    before = W.partitionBy("input_file").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    ends = ends.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).select("input_file", "_block", "_least", "_before")
    return rows.join(ends, ["input_file", "_block"]).select("input_file", (F.col("_before") + F.col("_id") - F.col("_least") + 1).alias("line_number"), "value")


def bad_lines(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """The numbered lines that are neither blank nor a JSON object."""
    return numbered_lines(spark, paths).where(F.trim("value") != "").where(F.json_object_keys("value").isNull())


def check_lines(spark: SparkSession, paths: list[str] | str) -> None:
    """An error that names the first bad line of the first file which has one."""
    first = bad_lines(spark, paths).orderBy("input_file", "line_number").limit(1).collect()
    if first:
        raise ValueError(f"{first[0].input_file}, line {first[0].line_number}: no JSON object")


def expand_sources(spark: SparkSession, inputs: list[str] | str) -> dict[str, list[str]]:
    """The files under files, folders (with all below) and globs by suffix, each once however often it is named; nothing found is an error."""
    wanted = [inputs] if isinstance(inputs, str) else inputs
    found = _present(spark, list(dict.fromkeys(wanted)))
    out: dict[str, list[str]] = {}
    if found:
        listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{{{','.join(SUFFIXES)}}}").load(found)
        for r in listed.select("path").distinct().orderBy("path").collect():  # names of files, which the driver lists for any read
            out.setdefault(r.path.rsplit(".", 1)[1], []).append(r.path)
    if not out:
        raise FileNotFoundError(f"no {', '.join(SUFFIXES)} files under {wanted}")
    return out


def source_roots(spark: SparkSession, inputs: list[str] | str) -> list[str]:
    """What the inputs name, each once and none below another: folders stay folders, whatever lies in them."""
    conf, roots = spark.sparkContext._jsc.hadoopConfiguration(), set()
    for name in [inputs] if isinstance(inputs, str) else inputs:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        roots.update(found.getPath().toString() for found in place.getFileSystem(conf).globStatus(place) or [])
    out: list[str] = []
    for root in sorted(roots, key=lambda r: r.split("/")):
        if not out or not root.startswith(f"{out[-1]}/"):
            out.append(root)
    return out


def read_sources(spark: SparkSession, inputs: list[str] | str, schema: str = EVENT) -> DataFrame:
    """Events of all supported files under the inputs: JSON lines, JSON documents, and CSV whose columns the schema gives their types.

    A file counts once however often the inputs name it. Each kind is one read
    of the folders with a filter on names; no list of files passes the driver.
    """
    roots, frames = source_roots(spark, inputs), []
    name = F.substring_index("path", "/", -1)
    kind = F.when(name.rlike(r"\.(jsonl|ndjson)$|^part-.*\.json$"), "lines").otherwise(F.regexp_extract(name, r"\.([a-z]+)$", 1))
    kinds = set()
    if roots:
        listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{{{','.join(SUFFIXES)}}}").load(roots)
        kinds = {r.kind for r in listed.select(kind.alias("kind")).distinct().collect()}  # three at most
    if not kinds:
        raise FileNotFoundError(f"no {', '.join(SUFFIXES)} files under {inputs}")
    if "lines" in kinds:
        frames.append(read_events(spark, roots, schema).select(*T.StructType.fromDDL(schema).names))
    if "json" in kinds:
        frames.append(read_document(spark, roots, schema, below=True))
    if "csv" in kinds:
        flat = read_flat_csv(spark, roots, below=True)
        frames.append(flat.select(*typed(flat, T.StructType.fromDDL(schema))))
    return union_sources(frames)


def typed(frame: DataFrame, kind: T.StructType, above: str = "") -> list[Column]:
    """Columns of the schema from a frame whose leaves are texts: what is no value of its type, and what is not there, is null."""
    out = []
    for field in kind.fields:
        path = f"{above}{field.name}"
        if isinstance(field.dataType, T.StructType):
            column = F.struct(*typed(frame, field.dataType, f"{path}."))
        elif not has_path(frame.schema, path):
            column = F.lit(None).cast(field.dataType)
        else:
            column = F.from_json(path, field.dataType) if isinstance(field.dataType, (T.ArrayType, T.MapType)) else F.col(path).try_cast(field.dataType)
        out.append(column.alias(field.name))
    return out


def read_document(spark: SparkSession, paths: list[str] | str, schema: str = EVENT, below: bool = False) -> DataFrame:
    """JSON documents: a list of events, or an object that holds it under events, data, records or Records. `below` takes the `.json` files in all folders below the paths, but for files of lines."""
    if below:
        raw = spark.read.text(paths, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json").where(~F.col("_metadata.file_name").startswith("part-"))
    else:
        raw = spark.read.text(paths, wholetext=True)
    inner = F.coalesce(*(F.get_json_object("value", f"$.{n}") for n in ("events", "data", "records", "Records")))
    listed = F.when(F.ltrim("value").startswith("["), F.col("value")).otherwise(inner)
    return raw.select(F.explode(F.from_json(listed, f"array<struct<{schema_fields(schema)}>>")).alias("e")).select("e.*")


def schema_fields(schema: str) -> str:
    """A column list as the inside of a struct type."""
    return ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in T.StructType.fromDDL(schema).fields)


def read_flat_csv(spark: SparkSession, paths: list[str] | str, below: bool = False) -> DataFrame:
    """Flattened events whose dotted headers become nested columns. `below` takes the `.csv` files in all folders below the paths."""
    reader = spark.read.option("header", True)
    rows = (reader.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv") if below else reader).csv(paths)
    tree: dict = {}
    for name in rows.columns:
        node = tree
        *above, leaf = name.split(".")
        for part in above:
            node = node.setdefault(part, {})
        node[leaf] = F.col(f"`{name}`")

    def build(node: dict) -> list[Column]:
        return [(F.struct(*build(v)) if isinstance(v, dict) else v).alias(k) for k, v in node.items()]

    return rows.select(*build(tree))


def read_audit(spark: SparkSession, paths: list[str] | str, schema: str, wrapped: bool) -> DataFrame:
    """Raw audit records, one per line, or (`wrapped`) documents with Records or a bare list."""
    return read_document(spark, paths, schema) if wrapped else spark.read.schema(schema).json(paths)


def union_sources(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def days_between(frame: DataFrame, start: str, end: str) -> DataFrame:
    """Rows of the days from start to end, both included; prunes partitions by day."""
    return frame.where(F.col("day").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


# Raw text.

_ADDRESS, _NUMBER = r"\d{1,3}(?:\.\d{1,3}){3}", r"\d+"
_FLOW_PARTS = {"version": r"\d", "account_id": r"\d{12}", "interface_id": "eni-[0-9a-f]+", "srcaddr": _ADDRESS, "dstaddr": _ADDRESS, "start": r"\d{9,11}", "end": r"\d{9,11}", "action": "ACCEPT|REJECT", "log_status": "OK|NODATA|SKIPDATA"}
FLOW_LINE = r"\s+".join(f"({_FLOW_PARTS.get(f, _NUMBER)})" for f in FLOW_FIELDS)
_ACCESS_PARTS = {"bucket_owner": "([0-9a-f]{32,64})", "timestamp": r"\[([^\]]+)\]", "request_uri": '"([^"]*)"', "referer": '"([^"]*)"', "user_agent": '"([^"]*)"', "version_id": r"([A-Za-z0-9\-_.]*)"}
ACCESS_LINE = r"\s+".join(_ACCESS_PARTS.get(f, r"(\S+)") for f in ACCESS_FIELDS)
FLOW_MARKERS, ACCESS_MARKERS = ["vpcflow"], ["aws:s3:accesslogs"]
SOURCE_MARKER = r"sourcetype::([A-Za-z0-9:_\-./]+)"


def parse_lines(texts: DataFrame, column: str, pattern: str, fields: list[str], markers: list[str] | None = None) -> DataFrame:
    """Every match of the pattern anywhere in texts that hold one of the markers, as named fields, each record once."""
    rows = texts
    if markers:
        held = F.lit(False)
        for m in markers:
            held = held | F.col(column).contains(m)
        rows = rows.where(held)
    found = rows.select(F.explode(F.regexp_extract_all(column, F.lit(pattern), F.lit(0))).alias("_line"))
    between = "\u0001"  # the fields of a line in one text: the pattern runs once a line, and equal records are equal texts
    plain = found.select(F.regexp_replace("_line", pattern, between.join(f"${i}" for i in range(1, len(fields) + 1))).alias("_fields")).distinct()
    return plain.select(F.split("_fields", between).alias("_f")).select(*(F.col("_f")[i].alias(f) for i, f in enumerate(fields)))


def flow_lines(texts: DataFrame, column: str = "value", marked: bool = True) -> DataFrame:
    return parse_lines(texts, column, FLOW_LINE, FLOW_FIELDS, FLOW_MARKERS if marked else None)


def access_lines(texts: DataFrame, column: str = "value", marked: bool = True) -> DataFrame:
    return parse_lines(texts, column, ACCESS_LINE, ACCESS_FIELDS, ACCESS_MARKERS if marked else None)


#: The keys by which a JSON record's kind is told.
SHAPES = {
    "cloudtrail": ["eventVersion", "eventSource", "eventName"], "guardduty": ["schemaVersion", "type", "accountId", "region"],
    "vpcflow": ["version", "account-id", "interface-id", "srcaddr", "dstaddr", "srcport", "dstport", "protocol", "packets", "bytes", "start", "end", "action", "log-status"],
}


def record_shape(text: Column) -> Column:
    """The kind of a JSON text by the keys it has; null for others and for what is no object."""
    keys = F.json_object_keys(text)
    out = None
    for kind, names in SHAPES.items():
        holds = F.size(F.array_except(F.array(*map(F.lit, names)), F.coalesce(keys, F.array().cast("array<string>")))) == 0
        out = F.when(holds, kind) if out is None else out.when(holds, kind)
    return out


def exact_dedup(records: DataFrame) -> DataFrame:
    """Equal records once, whatever the order of their keys: parsed columns decide."""
    return records.dropDuplicates()


def canonical_json(text: Column | str) -> Column:
    """A JSON text in one form: keys in order, no blanks, numbers as numbers, fields outside any schema kept. What is no JSON stays as it is, trimmed."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.to_json(F.try_parse_json(text)), F.trim(text))


def deduplicate_raw(lines: DataFrame, column: str = "value") -> DataFrame:
    """One row per raw record with `copies`: records are equal if all their fields are, in any order, also those that no schema names.

    The columns are those of the copy whose text is least. Null texts are one record. Groups meet as 256-bit digests of the canonical text.
    """
    digest = F.sha2(F.coalesce(canonical_json(column), F.lit("")), 256)
    kept = F.min(F.struct(column, *(c for c in lines.columns if c != column)))
    return lines.groupBy(F.col(column).isNull().alias("_null"), digest.alias("_digest")).agg(kept.alias("_kept"), F.count("*").alias("copies")).select("_kept.*", "copies").select(*lines.columns, "copies")


def read_counts(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, mapped, failed): lines that were read and lines that were not."""
    return rows.groupBy(*by).agg(F.count_if(F.col("_corrupt_record").isNull()).alias("mapped"), F.count_if(F.col("_corrupt_record").isNotNull()).alias("failed"))


def source_inventory(texts: DataFrame, column: str, bucket: str, pattern: str = SOURCE_MARKER, keep: int = 5) -> DataFrame:
    """(bucket, name, n): the `keep` most frequent markers of each bucket, and, with a null bucket, all markers' totals."""
    found = texts.select(F.col(bucket).alias("bucket"), F.explode(F.regexp_extract_all(column, F.lit(pattern), 1)).alias("name"))
    counts = found.rollup("name", "bucket").agg(F.count("*").alias("n")).where("name IS NOT NULL")
    place = F.row_number().over(W.partitionBy("bucket").orderBy(F.desc("n"), "name"))
    ranked = counts.where("bucket IS NOT NULL").withColumn("_place", place).where(F.col("_place") <= keep).drop("_place")
    return ranked.select("bucket", "name", "n").unionByName(counts.where("bucket IS NULL").select("bucket", "name", "n"))


# Sinks.

#: Fixed value: the columns an alert file starts with; others follow.
ALERT_COLUMNS = [
    "alert_family", "alert_type", "risk_score", "combined_risk_score", "network_risk_score", "time_based_risk_score", "time_detection_types", "cloud_account", "principal", "entity_key", "entity_type",
    "src_ip", "src_uid", "interface_uid", "destination", "log_sources", "first_seen", "last_seen", "duration_hours", "duration_days", "event_count", "total_bytes_out", "alert_reasons",
]


def _stripped(value: Column, kind: T.DataType, listed: bool = False) -> Column:
    if isinstance(kind, T.StructType):
        fields = [_stripped(value[f.name], f.dataType).alias(f.name) for f in kind.fields]
        held = F.coalesce(*(F.when(f.isNotNull(), True) for f in fields)) if fields else F.lit(None)
        return F.when(value.isNotNull() if listed else held, F.struct(*fields))
    if isinstance(kind, T.ArrayType):
        kept = F.filter(F.transform(value, lambda v: _stripped(v, kind.elementType, True)), lambda v: v.isNotNull())
    elif isinstance(kind, T.MapType):
        kept = F.map_filter(F.transform_values(value, lambda _, v: _stripped(v, kind.valueType)), lambda _, v: v.isNotNull())
    else:
        return value
    return kept if listed else F.when(F.size(kept) > 0, kept)


def strip_empty(events: DataFrame) -> DataFrame:
    """Null for every field at any depth that holds an empty list, an empty map or a struct without values; null elements leave lists.

    Empty texts stay, and so do lists and structs without values inside a list.
    """
    return events.select(*(_stripped(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in events.schema.fields))


def write_events(events: DataFrame, path: str, mode: str = "overwrite", by: list[str] | None = None) -> None:
    """JSON lines without null fields, one folder per value of `by`; `read_events` reads them back."""
    events.write.mode(mode).partitionBy(*(by or [])).option("ignoreNullFields", True).json(path)


def write_table(frame: DataFrame, path: str, by: list[str] | None = None, mode: str = "overwrite") -> None:
    """Parquet, one folder per value of `by` (source and day, say)."""
    frame.write.mode(mode).partitionBy(*(by or [])).parquet(path)


def flat_text(frame: DataFrame) -> DataFrame:
    """Nested columns as JSON, for files that hold none."""
    nested = (T.StructType, T.ArrayType, T.MapType)
    return frame.select(*(F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`") for f in frame.schema.fields))


def alert_columns(alerts: DataFrame) -> DataFrame:
    first = [c for c in ALERT_COLUMNS if c in alerts.columns]
    return alerts.select(*first, *(c for c in alerts.columns if c not in first))


def write_csv(frame: DataFrame, path: str, mode: str = "overwrite") -> None:
    flat_text(frame).write.mode(mode).option("header", True).csv(path)


def read_results(spark: SparkSession, path: str, days: tuple[str, str] | None = None) -> DataFrame:
    frame = spark.read.parquet(path)
    return days_between(frame, *days) if days else frame
