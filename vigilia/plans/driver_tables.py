"""The detectors' inputs as views of the driver's tables.

`events` act as API activity, `orders` as object accesses, `lineitem` as flows.
Operations come from a table of twenty real names by event type and k mod 4.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilia.functions import exprs as X

CUTOFF, TRADE_CUTOFF = "2024-01-22", "2000-01-01"
GAP_MINUTES = 12 * 60

# The operation of an event type for k mod 4 = 0, 1, 2, 3.
OPERATIONS = {
    "signup": ["AssumeRole", "ConsoleLogin", "CreateUser", "ListRoles"],
    "purchase": ["PutBucketPolicy", "CreateAccessKey", "RunInstances", "CreateSnapshot"],
    "error": ["StopLogging", "AuthorizeSecurityGroupIngress", "GetSecretValue", "InvokeFunction"],
    "view": ["ListBuckets", "GetBucketPolicy", "DescribeInstances", "HeadObject"],
    "click": ["GetObject", "GetObject", "PutObject", "CreateLoginProfile"],
}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def api_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.regexp_extract("props", "([0-9]+)", 1).try_cast("int")
    names = {f"{kind}{i}": op for kind, ops in OPERATIONS.items() for i, op in enumerate(ops)}
    rows = read(spark, sf_dir, "events").withColumn("k", k)
    return rows.select(
        F.col("event_id").alias("event_uid"), F.col("ts").cast("timestamp").alias("event_time"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("actor"), "k",
        X.lookup(names, F.concat("event_type", (F.col("k") % 4).cast("string"))).alias("operation"), F.concat(F.lit("res_"), F.col("k").cast("string")).alias("resource"),
        F.concat(F.lit("ip_"), (F.col("k") % 20).cast("string")).alias("ip"), F.concat(F.lit("reg_"), F.expr("k div 5").cast("string")).alias("region"),
        F.round(F.col("value") * 100).cast("long").alias("bytes"), (F.col("event_type") == "error").alias("failed"), F.expr("user_id % 10 = 0").alias("is_system"),
        F.when(F.col("k") % 5 != 0, F.concat(F.lit("AID"), F.col("user_id").cast("string"), F.lit("-"), (F.col("k") % 3).cast("string"))).alias("uid"), F.concat(F.lit("arn:"), F.col("user_id").cast("string"), F.lit("/"), (F.col("k") % 3).cast("string")).alias("uid_alt"),
        F.when(F.col("k") % 4 == 0, "AssumedRole").otherwise("IAMUser").alias("type"),
    ).withColumn("resources", F.array("resource"))


def session_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api_events(spark, sf_dir).select(
        F.col("actor").alias("identity_id"), "event_time", "event_uid", F.col("operation").alias("event_name"), F.coalesce(_service(), F.lit("none")).alias("event_source"),
        F.col("ip").alias("source_ip"), F.col("region").alias("aws_region"), X.action_category("operation").alias("action_category"), X.is_sensitive("operation").alias("is_sensitive"), F.col("failed").alias("is_failed"),
    )


def _service():
    from vigilia.functions.fixed import service_map

    return X.lookup(service_map(), F.col("operation"))


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem")
    part = F.col("l_partkey")
    return rows.select(
        F.concat(F.lit("eni-"), F.col("l_suppkey").cast("string")).alias("eni"), F.concat(F.lit("ip_"), (F.col("l_suppkey") % 40).cast("string")).alias("src_ip"),
        F.when(part % 4 == 0, F.concat(F.lit("r"), (part % 200).cast("string"))).otherwise(F.concat(F.lit("d"), (part % 5).cast("string"))).alias("dst_ip"),
        F.col("l_linenumber").alias("dst_port"), (F.col("l_linenumber") % 3).alias("protocol"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("bytes"),
        F.when(F.col("l_returnflag") == "R", "REJECT").otherwise("ACCEPT").alias("action"), F.col("l_shipdate").cast("timestamp").alias("event_time"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("event_uid"),
        F.col("l_suppkey").alias("suppkey"), F.col("l_linestatus").alias("user_agent"),
    )


def accesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("actor"), F.col("o_orderdate").cast("timestamp").alias("event_time"), F.concat(F.lit("Op"), (F.col("o_orderkey") % 3).cast("string")).alias("operation"),
        F.col("o_orderpriority").alias("bucket"), F.concat(F.lit("ip_"), (F.col("o_custkey") % 7 + F.col("o_orderkey") % 2).cast("string")).alias("ip"), F.round(F.col("o_totalprice") * 100).cast("long").alias("bytes"),
        F.when(F.col("o_orderstatus") == "F", 403).otherwise(200).alias("code"), F.col("o_orderkey").alias("event_uid"),
    )


def exfil_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows as the exfiltration detector reads them: an interface is the entity."""
    no = lambda x: F.lit(x)
    return flows(spark, sf_dir).select(
        no("acct").alias("cloud_account"), no("unknown_principal").alias("principal"), F.concat(no("interface:acct:"), "eni").alias("entity_key"), no("interface").alias("entity_type"), "src_ip", no("unknown_src_uid").alias("src_uid"),
        F.col("eni").alias("interface_uid"), F.col("dst_ip").alias("destination"), "event_time", "event_uid", F.col("bytes").alias("bytes_out"), no(0).cast("long").alias("bytes_in"), no("flow").alias("api_operation"),
        no("network").alias("api_service"), "user_agent", F.concat(no("part"), F.col("dst_port").cast("string")).alias("resource"), no("vpc_flow").alias("log_source"),
    )


def exfil_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """API events as object reads: every user is a principal; view and click events are reads of objects."""
    no = lambda x: F.lit(x)
    reading = F.col("operation").isin("GetObject", "ListBuckets", "HeadObject", "PutObject")
    return api_events(spark, sf_dir).select(
        no("acct").alias("cloud_account"), F.col("actor").alias("principal"), F.concat(no("principal:acct:"), "actor").alias("entity_key"), no("principal").alias("entity_type"), no("unknown_src").alias("src_ip"),
        no("unknown_src_uid").alias("src_uid"), no("unknown_interface").alias("interface_uid"), no("unknown_destination").alias("destination"), "event_time", "event_uid", F.col("bytes").alias("bytes_out"),
        no(0).cast("long").alias("bytes_in"), F.when(reading, F.concat(no("GetObject"), F.col("operation"))).otherwise(F.col("operation")).alias("api_operation"),
        F.when(reading, "s3.amazonaws.com").otherwise("other").alias("api_service"), no("agent").alias("user_agent"), "resource", no("cloudtrail").alias("log_source"),
    )
