"""Near-duplicate classes by ProbMinHash.

A text is its set of runs of five words (lower case, punctuation dropped). Each
run is a Poisson process of arrivals at rate its weight over all registers; a
register keeps the run that arrives first, so two texts agree in a register
with the probability Jaccard similarity of their weighted runs. All runs weigh
1, however often they repeat: the similarity is then that of the sets, by which
links are verified. Arrivals of a run grow in time, and it stops once it is later
than every register of its text: most runs of a long text draw one number.

Registers are banded. Texts in one bucket are linked by stars, to the first
and to the last text of the bucket, and each star's ray is verified by the
exact Jaccard similarity of the sets of runs. Links are closed into classes,
and buckets that hold texts of several classes are looked at again: small ones
pair all texts across classes; large ones first pair texts with drawn members
of their largest class and of another, and what they still hold in several
classes goes through an exact join on the first runs of each text, rarest
first. So every pair of a bucket that is not in one class has been ruled out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigilia.llm.common import cut, fresh
from vigilia.llm.textbytes import BREAK, U64, folded, map_texts, mix, shingle_hashes, sorted_sets, word_bounds, word_hashes

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 32, 4
SMALL_BUCKET = 48
BROADCAST_ROWS = 50_000  # of two ids each
GOLDEN = U64(0x9E3779B97F4A7C15)


def _uniform(h: np.ndarray) -> np.ndarray:
    return ((h >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53


def prob_minhash(elements: np.ndarray, weights: np.ndarray, first: np.ndarray, registers: int) -> np.ndarray:
    """(rows, registers) of the element that arrives first in each register; 0 for rows without elements."""
    rows = len(first) - 1
    times, winners = np.full(rows * registers, np.inf), np.zeros(rows * registers, U64)
    row = np.repeat(np.arange(rows), np.diff(first))
    left, clock, turn = np.arange(len(elements)), np.zeros(len(elements)), 0
    while len(left):
        turn += 1
        draw = mix(elements[left] + U64(int(GOLDEN) * turn % (1 << 64)))
        clock -= np.log(_uniform(draw)) / weights[left]
        cell = row[left] * registers + (mix(draw ^ GOLDEN) % U64(registers)).astype(np.int64)
        np.minimum.at(times, cell, clock)
        won = times[cell] == clock
        winners[cell[won]] = elements[left[won]]
        latest = times.reshape(rows, registers).max(axis=1)
        more = clock < latest[row[left]]
        left, clock = left[more], clock[more]
    return winners.reshape(rows, registers)


def text_sets(data: np.ndarray, at: np.ndarray, k: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data = folded(data)
    starts, ends, first = word_bounds(data, at, BREAK)
    return sorted_sets(*shingle_hashes(word_hashes(data, starts, ends), first, k))


def _lists(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int64()))


def _kind(frame: DataFrame) -> str:
    return frame.schema["id"].dataType.simpleString()


def sketches(docs: DataFrame, text: str) -> DataFrame:
    """Add `bands` (one 64-bit key per band; none for texts without words) to (id, digest, text); the text is dropped."""

    def run(batch, data, at):
        elements, _, first = text_sets(data, at)
        signature = prob_minhash(elements, np.ones(len(elements)), first, BANDS * ROWS).reshape(len(at) - 1, BANDS, ROWS)
        keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=U64) * GOLDEN, signature.shape[:2]).copy()
        for j in range(ROWS):
            keys = mix(keys ^ signature[:, :, j]) * GOLDEN
        some = np.diff(first) > 0
        offsets = np.concatenate([[0], np.cumsum(some * BANDS)])
        return {"id": batch.column(0), "digest": batch.column(1), "bands": _lists(keys[some].ravel().view(np.int64), offsets)}

    return map_texts(docs, run, f"id {_kind(docs)}, digest string, bands array<long>", text)


def run_sets(buckets: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, runs): the set of runs of each text that shares a bucket with another, written once for all verifications."""

    def run(batch, data, at):
        elements, _, first = text_sets(data, at)
        return {"id": batch.column(0), "runs": _lists(elements.view(np.int64), first)}

    wanted = buckets.select("id").distinct()
    return cut(map_texts(texts.join(wanted, "id", "left_semi").select("id", "text"), run, f"id {_kind(texts)}, runs array<long>"))


def _sized(written: DataFrame) -> DataFrame:
    """A written table for a join: broadcast up to BROADCAST_ROWS rows. Files of ids compress far below what a broadcast of them takes, so their size must not decide."""
    return F.broadcast(written) if written.count() <= BROADCAST_ROWS else written.hint("merge")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of (a, b) whose sets of runs have at least that Jaccard similarity."""
    ours, theirs = sets.select(F.col("id").alias("a"), F.col("runs").alias("_a")), sets.select(F.col("id").alias("b"), F.col("runs").alias("_b"))
    common = F.size(F.array_intersect("_a", "_b"))
    joined = _sized(pairs).join(theirs, "b").join(ours, "a").where(F.size("_a") >= similarity * F.size("_b")).where(F.size("_b") >= similarity * F.size("_a"))
    return cut(joined.withColumn("_c", common).where(F.col("_c") >= similarity * (F.size("_a") + F.size("_b") - F.col("_c"))).select("a", "b"))


def components(edges: DataFrame) -> DataFrame:
    """(id, class): each id of (a, b) with the least id that it hangs together with.

    Turns of large star and small star, until one changes nothing: then every
    id has one edge, to the least. A turn is three shuffles of the edge list,
    which is written to the shared folder; the number of turns grows with the
    logarithm of the longest chain.
    """
    ways = lambda *pairs: F.explode(F.array(*(F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for x, y in pairs)))
    before, least = None, F.min("b").over(Window.partitionBy("a"))
    while True:
        both = edges.where("a <> b").select(ways(("a", "b"), ("b", "a")).alias("e")).select("e.*")
        large = both.withColumn("m", F.least("a", least)).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = large.withColumn("m", least).select(ways(("a", "m"), ("b", "m")).alias("e")).select("e.*")
        edges = cut(small.where("a <> b").distinct())
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("id"), F.col("b").alias("class")).union(edges.select(F.col("b").alias("id"), F.col("b").alias("class")).distinct())


def _drawn(salt: int) -> F.Column:
    """An aggregate: one of a bucket's ids, another one in each bucket and at each salt."""
    return F.min_by("id", F.xxhash64("id", "key", F.lit(salt)))


def _paired(rays: DataFrame, a: str, b: str) -> DataFrame:
    return rays.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def _star(buckets: DataFrame) -> DataFrame:
    """Each bucket's texts paired with its first and its last one, which many buckets share, so that a large group gives few pairs a text."""
    ends = buckets.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    return _paired(buckets.join(ends, "key").select("id", F.explode(F.array("lo", "hi")).alias("end")), "id", "end")


def _mixed(buckets: DataFrame, classes: DataFrame) -> DataFrame:
    """(key, id, class, n): the texts, with their classes, of the buckets of several classes, and how many those have."""
    named = buckets.join(_sized(classes), "id", "left").select("key", "id", F.coalesce("class", "id").alias("class"))
    mixed = named.groupBy("key").agg(F.min("class").alias("x"), F.max("class").alias("y"), F.count("*").alias("n")).where("x <> y").select("key", "n")
    return named.join(mixed, "key")


def _across_small(mixed: DataFrame) -> DataFrame:
    """All pairs (a, b) of texts of one small bucket and different classes."""
    lists = mixed.where(F.col("n") <= SMALL_BUCKET).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("id", "class"))).alias("all"))  # SMALL_BUCKET at most
    one = lists.select("all", F.posexplode("all").alias("i", "l")).select("l", F.explode(F.slice("all", F.col("i") + 2, SMALL_BUCKET)).alias("r"))
    return one.where("l.class <> r.class").select(F.col("l.id").alias("a"), F.col("r.id").alias("b"))


def _across_large(mixed: DataFrame, look: int) -> DataFrame:
    """In each large bucket each text outside the largest class meets two drawn texts of that class and the head of the least other class: a few pairs a text."""
    big = mixed.where(F.col("n") > SMALL_BUCKET)
    heads = big.groupBy("key", "class").agg(F.count("*").alias("m"), _drawn(2 * look + 1).alias("h1"), _drawn(2 * look + 2).alias("h2"))
    main = heads.groupBy("key").agg(F.max(F.struct("m", "class", "h1", "h2")).alias("main"))
    other = heads.join(main, "key").where("class <> main.class").groupBy("key").agg(F.min(F.struct("class", "h1")).alias("other"))
    meets = main.join(other, "key").select("key", F.array(F.struct("main.class", F.col("main.h1").alias("h")), F.struct("main.class", F.col("main.h2").alias("h")), F.struct("other.class", F.col("other.h1").alias("h"))).alias("meets"), F.col("main.class").alias("_main"))
    far = big.join(meets, "key").where("class <> _main").select("id", "class", F.explode("meets").alias("e")).where("class <> e.class")
    return _paired(far.select("id", "e.h"), "id", "h")


def _shareable(wanted: DataFrame, sets: DataFrame) -> DataFrame:
    """(run, df, id, u, class, n): the runs of the texts `wanted` (id, class) that texts of another class among them have, too. `u` keeps rows of a repeated key apart."""
    runs = sets.join(wanted, "id").select("id", "class", F.size("runs").alias("n"), F.xxhash64("runs").alias("u"), F.explode("runs").alias("run"))
    shared = runs.groupBy("run").agg(F.count("*").alias("df"), F.min("class").alias("x"), F.max("class").alias("y")).where("x <> y").select("run", "df")
    return runs.join(shared, "run")


def _rest(mixed: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of different classes among the texts of large buckets of several classes: all that can have the similarity, and few others.

    A text that shares fewer than `similarity` of its runs with other classes
    has no partner and goes, and with it what others shared with it alone; again
    until few go. The others meet in a prefix-filter join. Runs stand in one
    order for all texts: first those that one class alone has, then the others by
    the number of their texts. A pair that is similar enough has a run in common
    among the longer one's first n - ceil(s n) + 1 and the shorter one's first
    n - ceil(2s / (1 + s) n) + 1, and from the first such run on, as well as in
    shared runs at all, both have the s / (1 + s) (n + m) runs it must have in
    common. So texts of one template, none of which is near another, meet in no row.
    """
    wanted = cut(mixed.where(F.col("n") > SMALL_BUCKET).select("id", "class").distinct())
    left = wanted.count()
    while left:
        some = _shareable(wanted, sets).groupBy("id", "u", "class", "n").agg(F.count("*").alias("a")).where(F.col("a") >= similarity * F.col("n") - 1e-6)
        fewer = cut(some.select("id", "class").distinct())
        before, left, wanted = left, fewer.count(), fewer
        if left > 0.9 * before:
            break
    if not left:
        return wanted.select(F.col("id").alias("a"), F.col("id").alias("b"))
    text = Window.partitionBy("id", "u")
    placed = _shareable(wanted, sets).withColumn("have", F.count("*").over(text)).withColumn("place", F.col("n") - F.col("have") + F.row_number().over(text.orderBy("df", "run")))
    first = lambda share: F.col("n") - F.ceil(F.col("n") * share - 1e-6) + 1
    heads = cut(placed.where(F.col("place") <= first(similarity)).withColumn("short", F.col("place") <= first(2 * similarity / (1 + similarity))))
    return _met(heads, similarity)


def _sides(heads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows (run, id, class, n, have, place, short) of runs of several classes, as two sides of a join on (run, salt).

    Texts of a run's largest class only meet those of its other classes. All
    texts of a run are dealt over its salts, once each, and those of the other
    classes copied to every salt: so many salts that the copies of a run are at
    most twice its texts, and so grow with these.
    """
    each = heads.groupBy("run", "class").agg(F.count("*").alias("m"))
    runs = each.groupBy("run").agg(F.sum("m").alias("all"), F.max(F.struct("m", "class")).alias("main"), F.count("*").alias("k")).where("k > 1").select("run", "all", F.col("main.class").alias("main"), (F.col("all") - F.col("main.m")).alias("others"))
    salts = F.greatest(F.lit(1), F.least(F.ceil(F.col("all") / SMALL_BUCKET), F.floor(2 * F.col("all") / F.col("others")))).cast("int")
    lists = heads.join(runs.select("run", "main", salts.alias("salts")), "run").withColumn("other", F.col("class") != F.col("main"))
    side = lambda frame, name: frame.select("run", "salt", *(F.col(c).alias(f"{name}_{c}") for c in ("id", "class", "n", "have", "place", "short", "other")))
    dealt = side(lists.withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int")), "x")
    return dealt, side(lists.where("other").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))), "y")


def _met(heads: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of different classes of one run that can have the similarity."""
    dealt, copied = _sides(heads)
    # Merged: a broadcast would be chosen by the size before the salts, which multiply the copied side.
    met = dealt.join(copied.hint("merge"), ["run", "salt"]).where("x_class <> y_class AND (NOT x_other OR x_id < y_id)")
    met = met.where("(y_short AND y_n <= x_n) OR (x_short AND x_n <= y_n)").where(F.least("x_n", "y_n") >= similarity * F.greatest("x_n", "y_n") - 1e-6)
    need = (F.col("x_n") + F.col("y_n")) * (similarity / (1 + similarity)) - 1e-6
    met = met.where(F.least("x_have", "y_have") >= need).where(F.least(F.col("x_n") - F.col("x_place"), F.col("y_n") - F.col("y_place")) + 1 >= need)
    return _paired(met, "x_id", "y_id")


def _classes(docs: DataFrame, key: str, text: str, similarity: float, looks: int) -> DataFrame:
    """(id, class) of the texts that have a class with others, as near_duplicates."""
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    rows = rows.withColumn("digest", F.md5(F.col("text").cast("binary")))
    seen = cut(sketches(rows.select("id", "digest", "text"), "text"))
    heads = cut(seen.groupBy("digest").agg(F.min("id").alias("head"), F.count("*").alias("n"), F.first("bands").alias("bands")))
    copies = seen.join(heads.where("n > 1").select("digest", "head"), "digest").where("id <> head").select(F.col("id").alias("a"), F.col("head").alias("b")).distinct()
    bands = heads.select(F.col("head").alias("id"), F.explode("bands").alias("key")).distinct()
    full = bands.groupBy("key").agg(F.min("id").alias("x"), F.max("id").alias("y")).where("x <> y").select("key")
    buckets = cut(bands.join(full, "key"))  # only buckets of several texts
    sets = run_sets(buckets, rows.select("id", "text"))
    tried = cut(_star(buckets))
    classes = cut(components(_verified(tried, sets, similarity).union(copies)))
    stars = lambda: classes.select(F.col("id").alias("a"), F.col("class").alias("b"))  # noqa: E731  what is known, as edges: later turns start from classes
    mixed = cut(_mixed(buckets, classes))
    for look in range(looks):
        far = _across_large(mixed, look)
        pairs = cut((far if look else _across_small(mixed).unionByName(far)).distinct().join(_sized(tried), ["a", "b"], "left_anti"))  # the first look tries all pairs of small buckets
        found = _verified(pairs, sets, similarity)
        tried = tried.union(pairs)
        if found.isEmpty():
            break
        classes = cut(components(stars().union(found)))
        mixed = cut(_mixed(buckets, classes))
    rest = cut(_rest(mixed, sets, similarity).join(_sized(tried), ["a", "b"], "left_anti"))
    found = rest if rest.isEmpty() else _verified(rest, sets, similarity)
    return classes if found.isEmpty() else components(stars().union(found))


def near_duplicates(docs: DataFrame, key: str, text: str, similarity: float = SIMILARITY, looks: int = 3) -> DataFrame:
    """(key, class_id) for every row: rows of one class hang together by links of similarity >= `similarity`; a class is named by its least key.

    Equal texts share a class, texts of fewer than five words count as one run,
    texts without words are alone unless equal, and a null text is alone. A key
    names a document, and may be of any type that has an order: rows that repeat
    a key are one document, even if their texts differ. A null key has a null
    class. Other columns are ignored. An empty table gives no rows. `looks` (one
    at least) only tells how long drawn pairs are tried in large buckets before
    the exact join.
    """
    named = docs.select(F.col(key).alias("id")).join(_classes(docs, key, text, similarity, looks), "id", "left")
    return named.select(F.col("id").alias(key), F.coalesce("class", "id").alias(*fresh([key], "class_id")))


def keep_one(docs: DataFrame, key: str, text: str, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of `docs` whose key is its class's least, each key once; rows with a null key or text stay. Columns keep their names, whatever these are."""
    out = _classes(docs, key, text, similarity, 3).where("id <> class").select(F.col("id").alias(key)).distinct()
    kept = docs.join(out, key, "left_anti")
    again = cut(kept.where(F.col(key).isNotNull()).groupBy(F.col(key)).agg(F.count("*").alias(*fresh([key], "_n"))).where(F.col(*fresh([key], "_n")) > 1).select(key))
    if again.isEmpty():
        return kept
    return kept.join(again, key, "left_anti").unionByName(kept.join(again, key, "left_semi").dropDuplicates([key]))
