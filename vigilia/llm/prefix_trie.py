"""Prefix trie of conversations, rolled up by depth bands.

A node is a distinct sequence of first turns. It is named by the exclusive-or
of a 128-bit hash of each (depth, turn) on its path, which is associative, so
the names of a conversation's nodes come from running totals per stretch and a
carry per stretch, never from one task over a whole conversation.

Totals over subtrees are summed by bands of fixed height. A node hands its own
values to its ancestors inside its band alone. The band roots, with their
bands' totals, are a tree of the same kind that is lower by the height of a
band; it is rolled up in the same way. What a band root then has is handed to
the ancestors in the band above it. So a node is copied at most as often as a
band is high, and the rounds are the logarithm of the greatest depth.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from vigilia.llm.common import arrow_map, cut

BAND = 8  # levels of a band
BRANCH, SHARED = 20, 4  # conversations that branch off one, and one more than the turns they may take from it
END_BITS = 16  # ids of a span of 2 to this power are joined to one text
NODE = ["depth", "k1", "k2"]


def _lane(digest: Column, at: int) -> Column:
    """Sixteen hexadecimal digits as a signed 64-bit number."""
    return F.conv(F.substring(digest, at, 16), 16, -10).cast("long")


def _carried(window_of: list[str], order: str, value: Column) -> Column:
    """What stands before a stretch, over the stretches of one conversation."""
    return value.over(W.partitionBy(*window_of).orderBy(order).rowsBetween(W.unboundedPreceding, -1))


def rebuilt_turns(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Tables (conv, depth, k1, k2, words) of every prefix of every rebuilt conversation, the empty one included, and (conv, length).

    Rows are dealt by ranges of (conversation, turn), so a conversation that
    holds a third of all rows lies in many stretches. Rows of equal turn are
    ordered by role, then by the text's digest; repeated rows are turns of
    their own. Rows without a conversation id belong to none and are left out.
    The remainder of a negative id is negative, as in SQL.
    """
    said, spoken = F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(role), F.lit(""))
    digest = F.sha2(F.concat(F.octet_length(spoken).cast("string"), F.lit(":"), spoken, said), 256)
    rows = conversations.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), spoken.alias("role"), digest.alias("digest"), F.regexp_count(said, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
    )
    rows = cut(rows.repartitionByRange("conv", "turn", "role", "digest").withColumn("stretch", F.spark_partition_id()))
    stretches = rows.groupBy("conv", "stretch").agg(F.count("*").alias("n"))
    stretches = stretches.withColumn("before", F.coalesce(_carried(["conv"], "stretch", F.sum("n")), F.lit(0)))
    shared = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(SHARED)).cast("long")
    known = stretches.groupBy("conv").agg(F.sum("n").alias("n")).withColumns({"shared": shared, "source": F.col("conv") - F.col("conv") % BRANCH})
    sources = known.where(F.col("conv") % BRANCH == 0).select(F.col("conv").alias("source"), F.col("n").alias("there"))
    known = cut(known.join(sources, "source", "left").withColumn("taken", F.least("shared", F.coalesce("there", F.lit(0)))))

    place = F.row_number().over(W.partitionBy("conv", "stretch").orderBy("turn", "role", "digest")) + F.col("before")
    placed = rows.join(stretches.join(known.select("conv", "shared", "taken"), "conv").drop("n"), ["conv", "stretch"]).withColumn("place", place)
    own = placed.where(F.col("place") > F.col("shared")).select("conv", "stretch", (F.col("place") - F.col("shared") + F.col("taken")).alias("depth"), "digest", "words")
    heads = placed.where((F.col("place") < SHARED) & (F.col("conv") % BRANCH == 0)).select(F.col("conv").alias("source"), "place", "digest", "words")
    led = known.join(heads, "source").where(F.col("place") <= F.col("shared")).select("conv", F.lit(-1).alias("stretch"), F.col("place").alias("depth"), "digest", "words")
    turns = cut(own.union(led).select("conv", "stretch", F.col("depth").cast("long").alias("depth"), "words", *(F.xxhash64("depth", _lane("digest", at)).alias(f"h{i}") for i, at in ((1, 1), (2, 17)))))

    carry = turns.groupBy("conv", "stretch").agg(F.bit_xor("h1").alias("c1"), F.bit_xor("h2").alias("c2"))
    carry = carry.select("conv", "stretch", *(F.coalesce(_carried(["conv"], "stretch", F.bit_xor(c)), F.lit(0)).alias(c) for c in ("c1", "c2")))
    inside = W.partitionBy("conv", "stretch").orderBy("depth").rowsBetween(W.unboundedPreceding, 0)
    named = turns.join(carry, ["conv", "stretch"]).select("conv", "depth", *(F.bit_xor(f"h{i}").over(inside).bitwiseXOR(F.col(f"c{i}")).alias(f"k{i}") for i in (1, 2)), "words")
    zero = F.lit(0).cast("long")
    ends = known.select("conv", (F.col("taken") + F.greatest(F.col("n") - F.col("shared"), F.lit(0))).alias("length"))
    return cut(named.unionByName(known.select("conv", zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), zero.alias("words")))), ends


def _paths(prefixes: DataFrame, stride: int, band: int) -> DataFrame:
    """(conv, depth, k1, k2, words, up1, up2) of the prefixes at multiples of `stride`.

    `up1`, `up2` hold the names of the ancestors in the band of the parent, the
    highest first: at most `band`. A group holds a band and the root below it.
    """
    there = F.expr(f"depth div {stride * band}")
    groups = F.when((F.col("depth") > 0) & (F.col("depth") % (stride * band) == 0), F.array(there, there - 1)).otherwise(F.array(there))
    segments = (
        prefixes.where(F.col("depth") % stride == 0).select("conv", F.explode(groups).alias("band"), F.struct("depth", "k1", "k2", "words").alias("p"))
        .groupBy("conv", "band").agg(F.sort_array(F.collect_list("p")).alias("seg"))  # band + 1 entries at most
    )
    each = segments.select("conv", "seg", F.posexplode("seg").alias("i", "p")).where((F.col("i") > 0) | (F.col("p.depth") == 0))
    return each.select("conv", "p.*", F.slice("seg.k1", F.lit(1), F.col("i")).alias("up1"), F.slice("seg.k2", F.lit(1), F.col("i")).alias("up2"))


def _handed_up(rows: DataFrame, values: list[str], stride: int, itself: bool) -> DataFrame:
    """(node, values) for every ancestor in `up1`, `up2`, and for the node itself if asked."""
    up = F.transform(F.arrays_zip("up1", "up2"), lambda x, i: F.struct((F.col("depth") - (F.size("up1") - i) * stride).alias("depth"), x["up1"].alias("k1"), x["up2"].alias("k2")))
    if itself:
        up = F.concat(up, F.array(F.struct(*NODE)))
    return rows.select(F.explode(up).alias("to"), *values).select("to.*", *values)


def rolled_up(nodes: DataFrame, prefixes: DataFrame, values: list[str], band: int = BAND) -> DataFrame:
    """(node, values) with each value summed over the node's subtree. `nodes` has (node, up1, up2, values)."""
    deepest = nodes.agg(F.max("depth").alias("d")).first().d or 0
    sums = [F.sum(v).alias(v) for v in values]
    levels, stride = [nodes], 1
    totals = []
    while True:
        root = F.col("depth") % (stride * band) == 0  # its band is the one below it
        here = levels[-1].withColumns({u: F.when(root, F.array().cast("array<long>")).otherwise(F.col(u)) for u in ("up1", "up2")})
        totals.append(cut(_handed_up(here, values, stride, True).groupBy(*NODE).agg(*sums)))
        if deepest // stride < band:
            break
        stride *= band
        ways = _paths(prefixes, stride, band).groupBy(*NODE).agg(F.min(F.struct("conv", "up1", "up2")).alias("w")).select(*NODE, "w.up1", "w.up2")
        levels.append(totals[-1].where(F.col("depth") % stride == 0).join(ways, NODE))
    whole = totals[-1]
    for at in reversed(range(len(totals) - 1)):  # band roots' totals to the bands above them
        within = F.col("depth") % band ** (at + 1) != 0  # the others are band roots, whose totals are whole already
        roots = whole.where(F.col("depth") > 0).join(levels[at].where(~within).select(*NODE, "up1", "up2"), NODE)
        parts = totals[at].unionByName(_handed_up(roots, values, band**at, False)).where(within)
        whole = cut(parts.groupBy(*NODE).agg(*sums).unionByName(whole))
    return whole


def _ends(prefixes: DataFrame, lengths: DataFrame) -> DataFrame:
    """(node, ends_sha256) of the nodes at which conversations end: the digest of their ids in order.

    Ids are joined to texts by spans of ids, so a node at which a third of all
    conversations end reaches the task that hashes it as few rows, in order.
    """
    last = prefixes.join(lengths.select("conv", F.col("length").alias("depth")), ["conv", "depth"])
    pieces = last.groupBy(*NODE, F.shiftright("conv", END_BITS).alias("block")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("piece"))

    def run(batches):
        now, state = None, None
        for batch in batches:
            done = []
            for *node, piece in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if node != now:
                    if now is not None:
                        done.append((*now, state.hexdigest()))
                    now, state = node, hashlib.sha256(piece.encode())
                else:
                    state.update(b"," + piece.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=[*NODE, "ends_sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*now, state.hexdigest())], names=[*NODE, "ends_sha256"])

    return arrow_map(pieces.repartition(*NODE).sortWithinPartitions(*NODE, "block").select(*NODE, "piece"), run, "depth long, k1 long, k2 long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", band: int = BAND) -> DataFrame:
    """A row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Null roles and texts are empty; null turns come first; see `rebuilt_turns`
    for ties and rows without an id. The root has depth 0 and no parent. An
    empty table gives no rows, not even the root, as no conversation starts
    with nothing. Only the four named columns are read.
    """
    prefixes, lengths = rebuilt_turns(conversations, conv, turn, role, text)
    nodes = (
        _paths(prefixes, 1, band).groupBy(*NODE).agg(F.min(F.struct("conv", "words", "up1", "up2")).alias("w"), F.count("*").alias("n_convs"))
        .select(*NODE, "w.*", "n_convs", ((F.col("n_convs") - 1) * F.col("w.words")).alias("saved_tokens"))
    )
    nodes = cut(nodes.withColumns({f"p{i}": F.get(f"up{i}", F.size(f"up{i}") - 1) for i in (1, 2)}))
    parent = [(F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")]
    children = nodes.where(F.col("depth") > 0).select(*parent).groupBy(*NODE).agg(F.count("*").alias("n_children"))
    nodes = cut(nodes.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))).withColumn("n_leaves", (F.col("n_children") == 0).cast("long")))
    totals = rolled_up(nodes.select(*NODE, "up1", "up2", "saved_tokens", "n_leaves"), prefixes, ["saved_tokens", "n_leaves"], band)
    above = nodes.select(F.col("depth").alias("pd"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv").alias("parent_conv_id"))
    found = nodes.select(*NODE, "conv", "n_convs", "n_children", (F.col("depth") - 1).alias("pd"), "p1", "p2").join(above, ["pd", "p1", "p2"], "left")
    empty = hashlib.sha256(b"").hexdigest()
    return found.join(totals, NODE).join(_ends(prefixes, lengths), NODE, "left").select(
        F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"),
    )
