"""Sharding by fixed virtual slots.

A record hashes into one of thousands of slots. Bytes are summed per slot, and
a small versioned table maps slots to shards; rebalancing edits that table and
touches no record. The law is `bytes`: shards are near equal in bytes.

Only the slot table (as long as the number of slots, a parameter) reaches the
driver. Equal rows are counted before they are dealt, so a row that repeats
without end costs one group; its copies hash in blocks and spread over slots.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from vigilia.llm.common import cut, shared_dir

SLOTS = 16384
OVERHEAD = 16  # bytes a record costs besides its text
BLOCK = 64  # equal rows that share a slot


def rebalance(sizes: dict[int, int], placed: dict[int, int], shards: int, tolerance: float = 0.001) -> dict[int, int]:
    """The map with as few slots moved as bring every shard within `tolerance` of the mean, or as near as whole slots allow.

    Shards over the mean hand over slots, largest first where they fit, to a
    heap of what is missing elsewhere; what stays over is then evened by swaps.
    Slots on shards that no longer exist are dealt first.
    """
    out = {slot: shard for slot, shard in placed.items() if shard < shards}
    load = [0] * shards
    held: list[list[int]] = [[] for _ in range(shards)]
    for slot, shard in out.items():
        load[shard] += sizes.get(slot, 0)
        held[shard].append(slot)
    mean = sum(sizes.values()) / shards
    loose = [slot for slot in placed if slot not in out]
    for shard in range(shards):
        held[shard].sort(key=lambda s: (sizes.get(s, 0), s))
        keep = []
        for slot in reversed(held[shard]):  # large slots leave while the shard stays at or over the mean
            size = sizes.get(slot, 0)
            if size and load[shard] - size >= mean * (1 - tolerance) and load[shard] > mean * (1 + tolerance):
                load[shard] -= size
                loose.append(slot)
            else:
                keep.append(slot)
        held[shard] = keep
    heap = [(load[s], s) for s in range(shards)]
    heapq.heapify(heap)
    for slot in sorted(loose, key=lambda s: (-sizes.get(s, 0), s)):
        low, shard = heapq.heappop(heap)
        out[slot] = shard
        held[shard].append(slot)
        load[shard] = low + sizes.get(slot, 0)
        heapq.heappush(heap, (load[shard], shard))
    for _ in range(64 * shards):  # swaps between the fullest and the emptiest shard
        high, low = max(range(shards), key=lambda s: (load[s], s)), min(range(shards), key=lambda s: (load[s], s))
        gap = load[high] - load[low]
        if gap <= mean * tolerance or gap < 2:
            break
        ours = sorted((sizes.get(s, 0), s) for s in held[high])
        theirs = sorted([(0, -1), *((sizes.get(s, 0), s) for s in held[low])])
        best, j = None, 0
        for size, slot in ours:  # a pair whose difference is nearest to half the gap
            while j + 1 < len(theirs) and abs(size - theirs[j + 1][0] - gap / 2) <= abs(size - theirs[j][0] - gap / 2):
                j += 1
            rest = abs(size - theirs[j][0] - gap / 2)
            if 0 < size - theirs[j][0] < gap and (best is None or rest < best[0]):
                best = (rest, slot, theirs[j][1], size - theirs[j][0])
        if best is None:
            break
        _, mine, other, moved = best
        out[mine] = low
        held[high].remove(mine)
        held[low].append(mine)
        if other >= 0:
            out[other] = high
            held[low].remove(other)
            held[high].append(other)
        load[high] -= moved
        load[low] += moved
    return out


class SlotMap:
    """Versions of the slot-to-shard map in a folder, one folder of (virtual_slot, shard) each; a version once written is never changed."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def versions(self) -> list[int]:
        """The versions that were written to their end."""
        pattern = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/version=*/_SUCCESS")
        found = pattern.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern) or []
        return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found)

    def write(self, version: int, placed: dict[int, int]) -> None:
        """Fails if the version is there: of two writers one has to read the other's map and edit that."""
        rows = self.spark.createDataFrame(sorted(placed.items()), "virtual_slot int, shard int")
        rows.coalesce(1).write.mode("error").parquet(f"{self.path}/version={version}")

    def read(self, version: int | None = None) -> DataFrame:
        """One version, the newest if none is named."""
        return self.spark.read.schema("virtual_slot int, shard int").parquet(f"{self.path}/version={self.versions()[-1] if version is None else version}")


def shard_records(records: DataFrame, key: str, text: str, shards: int, slots: int = SLOTS, path: str | None = None, tolerance: float = 0.001) -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard, virtual_slot) per record.

    `slot` is a record's place in its shard, without gaps from 0. Null texts
    have no bytes and the CRC of nothing; null keys are dealt like any other
    value; rows that repeat are records of their own. An empty table gives no
    rows. Other columns are ignored. `path` holds the versions of the map:
    where there is none, version 0 deals slots in turn; the newest one is edited
    until the shards are near equal in bytes and written as the next version, so
    a second call on a path moves as few slots as its records ask for.
    """
    spark = records.sparkSession
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    slim = records.select(F.col(key).alias("k"), (F.octet_length(body) + OVERHEAD).cast("long").alias("size"), F.crc32(body).alias("crc"))
    blocks = (
        slim.groupBy("k", "size", "crc").agg(F.count("*").alias("n"))
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.expr(f"int((n - 1) div {BLOCK})"))))
        .withColumn("n", F.least(F.lit(BLOCK), F.col("n") - F.col("block") * BLOCK).cast("long"))
        .withColumn("virtual_slot", F.pmod(F.xxhash64("k", "size", "crc", "block"), F.lit(slots)).cast("int"))
    )
    blocks = cut(blocks)
    rows = blocks.groupBy("virtual_slot").agg(F.sum(F.col("n") * F.col("size")).alias("bytes"), F.sum("n").alias("rows")).collect()  # at most `slots` rows
    sizes, counts = {r.virtual_slot: r["bytes"] for r in rows}, {r.virtual_slot: r["rows"] for r in rows}
    store = SlotMap(spark, path or shared_dir(spark))
    found = store.versions()
    if not found:
        store.write(0, {slot: slot % shards for slot in range(slots)})
        found = [0]
    first = {r.virtual_slot: r.shard for r in store.read(found[-1]).collect()}  # `slots` rows
    if len(first) != slots:
        raise ValueError(f"the map has {len(first)} slots, not {slots}: the number of slots is fixed")
    placed = rebalance(sizes, first, shards, tolerance)
    store.write(found[-1] + 1, placed)
    filled, base = [0] * shards, []
    for slot in sorted(counts):
        base.append((slot, filled[placed[slot]]))
        filled[placed[slot]] += counts[slot]
    bases = spark.createDataFrame(base, "virtual_slot int, base long")
    places = store.read(found[-1] + 1).join(F.broadcast(bases), "virtual_slot")  # as many rows as slots
    order = W.partitionBy("virtual_slot").orderBy("k", "size", "crc", "block")
    return (
        blocks.withColumn("before", F.sum("n").over(order.rowsBetween(W.unboundedPreceding, -1)))
        .join(F.broadcast(places), "virtual_slot")
        .withColumn("copy", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))))
        .select(
            F.col("k").alias(key), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard",
            (F.col("base") + F.coalesce("before", F.lit(0)) + F.col("copy")).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"), "virtual_slot",
        )
    )
