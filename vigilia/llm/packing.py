"""Packing into fixed-length sequences by cutting-stock column generation.

A document's ids are cut into pieces of the sequence length and a rest. Rests
of one length are bundled until a bundle, rounded up to a grid, loses little by
that: sixteen rests of 3 ids fill three steps of 16 without loss. Bundles and
long rests fall into classes by rounded length; the histogram of classes is the
demand of a cutting-stock problem. Its linear program is solved by column
generation: a revised simplex over patterns, priced by an unbounded knapsack
dynamic program. Patterns are rounded down, what is left is packed by first
fit decreasing, and ranked pieces take the places that patterns offer to their
class. The histogram and the patterns are as long as the number of classes,
however many documents there are.
"""

from __future__ import annotations

import functools
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from vigilia.llm.common import arrow_map, cut, fresh
from vigilia.llm.textbytes import SPACE, U64, HashIndex, folded, mix, slices, word_bounds, word_hashes

SEQUENCE = 4096
GRID = 16
END_ID = 2
MAX_COLUMNS = 3000
GAP = 1e-4  # the linear program ends once it is within this share of its optimum
LOSS = 0.005  # share of a bundle's ids that rounding may cost
BUNDLE = 1024  # ids of a bundle of several rests at most
RANKED_ROWS = 2000  # pieces of a length that are ranked in one group; a length has as many groups as it needs
MEMO_WORDS = 1_000_000

PIECES = "start long, length long, ids_crc32 long, doc_tokens long"

#: Kinds of bytes: white space, letters, digits, signs, and all others, which make their whole chunk odd.
BLANK, LETTER, DIGIT, SIGN, OTHER, ODD = range(6)
_KIND = np.full(256, OTHER, np.uint8)
for _i in range(33, 127):
    _KIND[_i] = LETTER if chr(_i).isalpha() else DIGIT if chr(_i).isdigit() else SIGN
_KIND[SPACE] = BLANK
_KIND[[ord("'"), ord("|")]] = OTHER  # the apostrophe may join the letters after it; the bar stands in special tokens


def units(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends, odd, first): what the tokenizer encodes apart from its neighbours, in order, and each row's first.

    A unit is a run of letters (ASCII or Latin-1), a digit or a run of signs, in
    lower case; a chunk between blanks that holds any other byte is one unit as
    it stands, and odd.
    """
    n = len(data)
    kind = _KIND[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    second = data[lead + 1]
    lead = lead[(second >= 0x80) & (second <= 0xBF) & (second != 0x97) & (second != 0xB7)]
    kind[lead] = kind[lead + 1] = LETTER
    text = folded(data)
    if (kind == OTHER).any():
        starts, ends, _ = word_bounds(data, at, SPACE)
        others = np.concatenate([[0], np.cumsum(kind == OTHER)])
        odd = others[ends] > others[starts]
        border = np.zeros(n + 1, np.int8)
        border[starts[odd]] += 1
        border[ends[odd]] -= 1
        inside = np.cumsum(border[:n], dtype=np.int8) > 0
        kind[inside] = ODD
        text[inside] = data[inside]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    edge[1:n] |= (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
    edges = np.flatnonzero(edge)
    starts, ends = edges[:-1], edges[1:]
    some = kind[starts] != BLANK
    starts, ends = starts[some], ends[some]
    return text, starts, ends, kind[starts] == ODD, np.searchsorted(starts, at)


class WordEncoder:
    """The ids of whole texts, remembered per unit of text in tables of numbers.

    Exact for tokenizers that drop white space, put letters, digits and other
    signs into parts of their own, lower letters one by one and mark the last
    token of a part: a text's ids are then those of its units. Units are found
    by a 64-bit hash and told apart by their length and first eight bytes too.
    New ones go to the tokenizer many at a time as one text, which is told apart
    again at the marks; odd ones go to it as they are. The tables are emptied
    when they are full.
    """

    def __init__(self, path: str, most: int = MEMO_WORDS, end: str = "</w>"):
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.closing = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, number in self.tokenizer.get_vocab().items():
            self.closing[number] = token.endswith(end)
        self._empty()

    def _empty(self) -> None:
        self.keys, self.checks = np.zeros(0, U64), np.zeros(0, U64)
        self.begin, self.count, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        self.old, self.new, self.border = HashIndex(self.keys), HashIndex(self.keys), 0

    def _find(self, keys: np.ndarray) -> np.ndarray:
        place = self.old.find(keys).astype(np.int64)
        left = np.flatnonzero(place < 0)
        got = self.new.find(keys[left])
        place[left] = np.where(got >= 0, got + self.border, -1)
        return place

    def _encoded(self, words: list[str], odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words of which the odd ones stand last, one after another, and how many each has."""
        ids, count, plain = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)], len(words) - int(odd.sum())
        for at in range(0, plain, 2048):
            part = words[at : min(at + 2048, plain)]
            got = np.array(self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids, np.uint32)
            stops = np.flatnonzero(self.closing[got]) + 1
            if len(stops) != len(part):
                raise ValueError("the tokenizer does not mark the ends of words")
            ids.append(got)
            count.append(np.diff(stops, prepend=0))
        for code in self.tokenizer.encode_batch(words[plain:], add_special_tokens=False):
            ids.append(np.array(code.ids, np.uint32))
            count.append(np.array([len(code.ids)]))
        return np.concatenate(ids), np.concatenate(count)

    def _learn(self, keys: np.ndarray, checks: np.ndarray, words: list[str], odd: np.ndarray) -> None:
        ids, count = self._encoded(words, odd)
        self.begin = np.concatenate([self.begin, len(self.ids) + np.cumsum(count) - count])
        self.ids, self.count = np.concatenate([self.ids, ids]), np.concatenate([self.count, count])
        self.keys, self.checks = np.concatenate([self.keys, keys]), np.concatenate([self.checks, checks])
        if len(self.keys) - self.border > max(4096, self.border // 4):
            self.border, self.old = len(self.keys), HashIndex(self.keys)
        self.new = HashIndex(self.keys[self.border :])

    def encode(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows one after another, and each row's first (one more than rows)."""
        if len(data) < 2:
            data = np.concatenate([data, np.full(2, 32, np.uint8)])  # blanks beyond the last row
        text, starts, ends, odd, first = units(data, at)
        keys = word_hashes(text, starts, ends)
        keys[odd] = mix(keys[odd])
        size = ends - starts
        eight = np.ndarray(len(text), "<u8", np.concatenate([text, np.zeros(8, np.uint8)]).tobytes(), strides=(1,))[starts]
        eight &= (U64(1) << (U64(8) * np.minimum(size, 7).astype(U64))) - U64(1) | np.where(size > 7, U64(0xFF << 56), U64(0))
        checks = eight * U64(31) + size.astype(U64)
        if len(self.keys) > self.most:
            self._empty()
        place = self._find(keys)
        missing = np.flatnonzero(place < 0)
        if len(missing):
            fresh, which = np.unique(keys[missing], return_index=True)
            last = np.argsort(odd[missing[which]], kind="stable")
            fresh, which = fresh[last], missing[which][last]
            raw = text.tobytes()
            words = [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[which].tolist(), ends[which].tolist())]
            self._learn(fresh, checks[which], words, odd[which])
            place[missing] = self._find(keys[missing])
        begin, count, ids = self.begin[place], self.count[place], self.ids
        clash = np.flatnonzero(self.checks[place] != checks)
        if len(clash):  # units of equal hashes
            clash, raw = clash[np.argsort(odd[clash], kind="stable")], text.tobytes()
            got, count[clash] = self._encoded([raw[starts[i] : ends[i]].decode("utf-8", "replace") for i in clash.tolist()], odd[clash])
            begin[clash] = len(ids) + np.cumsum(count[clash]) - count[clash]
            ids = np.concatenate([ids, got])
        stop = np.concatenate([[0], np.cumsum(count)])
        return ids[np.repeat(begin - stop[:-1], count) + np.arange(stop[-1])], stop[first]


@functools.lru_cache(maxsize=1)
def _encoder(path: str, most: int) -> WordEncoder:
    """One per worker process, so that what a task has learned serves the next."""
    return WordEncoder(path, most)


def pieces(docs: DataFrame, key: str, text: str, tokenizer: str, length: int = SEQUENCE, end_id: int = END_ID, memo_words: int = MEMO_WORDS) -> DataFrame:
    """(_key, start, length, ids_crc32, doc_tokens) of each piece of each document. A null text is empty: its piece is the end id alone."""
    kind = docs.schema[key].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        encoder = _encoder(tokenizer, memo_words)
        for batch in batches:
            rows, parts = [], []
            for lo, hi, data, at in slices(batch, "_text"):
                ids, first = encoder.encode(data, at)
                raw, bounds = ids.astype("<u4", copy=False).tobytes(), first.tolist()
                for row, a, b in zip(range(lo, hi), bounds[:-1], bounds[1:]):
                    whole = raw[4 * a : 4 * b] + end
                    for start in range(0, b - a + 1, length):
                        part = whole[4 * start : 4 * (start + length)]
                        rows.append(row)
                        parts.append((start, len(part) // 4, zlib.crc32(part), b - a + 1))
            if rows:
                columns = list(zip(*parts))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows)), *(pa.array(c, pa.int64()) for c in columns)], names=["_key", "start", "length", "ids_crc32", "doc_tokens"]
                )

    return arrow_map(docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")), run, f"_key {kind}, {PIECES}")


def knapsack(values: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The multiset of items of most value that fits into `room`: its value and how often it takes each item."""
    best, choice = np.zeros(room + 1), np.full(room + 1, -1)
    for c in range(1, room + 1):
        best[c] = best[c - 1]
        fits = sizes <= c
        if fits.any():
            got = np.where(fits, values + best[c - np.minimum(sizes, c)], -np.inf)
            k = int(np.argmax(got))
            if got[k] > best[c] + 1e-12:
                best[c], choice[c] = got[k], k
    taken, c = np.zeros(len(values), int), room
    while c > 0:
        if choice[c] < 0:
            c -= 1
        else:
            taken[choice[c]] += 1
            c -= sizes[choice[c]]
    return float(best[room]), taken


def _inverted(matrix: np.ndarray) -> np.ndarray:
    """The inverse by elimination with row pivots. No call of a linear algebra library, whose threads stall beside a busy JVM."""
    m = len(matrix)
    work = np.concatenate([matrix.astype(float), np.eye(m)], axis=1)
    for i in range(m):
        k = i + int(np.argmax(np.abs(work[i:, i])))
        work[[i, k]] = work[[k, i]]
        row = work[i] / work[i, i]
        work -= work[:, i : i + 1] * row
        work[i] = row
    return work[:, m:]


def solve_patterns(sizes: np.ndarray, demand: np.ndarray, room: int, most: int = MAX_COLUMNS, gap: float = GAP) -> list[tuple[np.ndarray, float]]:
    """Patterns and how often the linear program uses each: minimise their number, covering the demand.

    The first basis has one pattern per class, filled with that class alone.
    `inverse` is the basis' inverse, updated by each pivot; dual prices are the
    inverse's column sums as every pattern costs one. The number of patterns
    over the best price is a lower bound, so it ends within `gap` of the optimum.
    """
    m = len(sizes)
    basis = [np.eye(m, dtype=int)[i] * (room // sizes[i]) for i in range(m)]
    inverse = np.diag([1 / (room // s) for s in sizes]).astype(float)
    times = lambda vector: (inverse * vector).sum(axis=1)
    amount = times(demand)
    for turn in range(most):
        value, pattern = knapsack(inverse.sum(axis=0), sizes, room)
        if value <= 1 + gap:
            break
        step = times(pattern)
        ratio = np.where(step > 1e-9, amount / np.where(step > 1e-9, step, 1), np.inf)
        leave = int(np.argmin(ratio))
        if not np.isfinite(ratio[leave]):
            break
        row = inverse[leave] / step[leave]
        inverse -= step[:, None] * row
        inverse[leave] = row
        basis[leave] = pattern
        if turn % 100 == 99:
            inverse = _inverted(np.stack(basis, axis=1))
        amount = np.maximum(times(demand), 0)
    return list(zip(basis, amount.tolist()))


def round_patterns(sizes: np.ndarray, demand: np.ndarray, room: int, solved: list[tuple[np.ndarray, float]]) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Whole sequences that cover the demand: patterns rounded down, then first fit decreasing for what they leave."""
    out, left = [], demand.astype(np.int64).copy()
    for pattern, amount in solved:
        whole = int(amount + 1e-6)
        if whole:
            out.append((pattern, whole))
            left -= pattern * whole
    kept = Counter()
    for pattern, whole in out:
        kept[tuple((int(i), int(pattern[i])) for i in np.flatnonzero(pattern))] += whole
    left = np.maximum(left, 0)
    order = np.argsort(-sizes, kind="stable")
    while left.any():  # each turn packs one sequence, and repeats it as often as the rest allows
        free, chosen = room, {}
        for i in order.tolist():
            n = min(int(left[i]), free // int(sizes[i]))
            if n:
                chosen[i] = n
                free -= n * int(sizes[i])
        times = min(int(left[i]) // n for i, n in chosen.items())
        for i, n in chosen.items():
            left[i] -= n * times
        kept[tuple(sorted(chosen.items()))] += times
    return sorted(kept.items())


def bundled(counts: dict[int, int], grid: int, ids: int = BUNDLE) -> tuple[dict[int, tuple[int, int, tuple[int, int], tuple[int, int]]], dict[int, int]]:
    """How pieces become items of the cutting-stock problem, and how many items each class has.

    For each length: pieces a bundle (of `ids` ids at most), number of whole
    bundles, class and first item of these, and class and item of the bundle
    that takes what is left.
    """
    items, demand = {}, defaultdict(int)

    def add(size: int, n: int) -> tuple[int, int]:
        c = -(-size // grid)
        demand[c] += n
        return c, demand[c] - n

    for size, n in sorted(counts.items()):
        loss = lambda k: (-k * size % grid) / (k * size)  # noqa: B023, E731
        most = range(1, max(1, min(n, ids // size)) + 1)
        each = next((k for k in most if loss(k) <= LOSS), min(most, key=loss))
        full = n // each
        items[size] = (each, full, add(each * size, full), add((n - full * each) * size, 1) if n % each else (0, 0))
    return items, dict(demand)


def pack(docs: DataFrame, key: str, text: str, tokenizer: str, length: int = SEQUENCE, grid: int = GRID, end_id: int = END_ID, memo_words: int = MEMO_WORDS) -> DataFrame:
    """(key, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every piece; sequence ids are gapless from 0.

    A worker remembers the ids of about `memo_words` words (some 100 bytes each);
    fewer cost time, not results. Null and empty texts are the end id alone. Rows
    that repeat, or have equal or null keys, are packed as documents of their
    own. An empty table gives no rows. Only the key and the text are read; a
    result named like the key has an underscore after it.
    """
    spark = docs.sparkSession
    made = pieces(docs, key, text, tokenizer, length, end_id, memo_words)
    made = cut(made.withColumn("_row", F.monotonically_increasing_id()))  # written once, so _row stays as it is
    counts = {r["length"]: r["count"] for r in made.groupBy("length").count().collect()}  # a row a length
    items, demand = bundled(counts, grid, min(BUNDLE, length // 4))
    sizes = np.array(sorted(demand), int)
    wanted = np.array([demand[s] for s in sizes.tolist()], np.int64)
    room = length // grid
    plan = round_patterns(sizes, wanted, room, solve_patterns(sizes, wanted.astype(float), room)) if len(sizes) else []
    # A run of a class' items that one pattern serves: from which item, how many a sequence, from which sequence.
    runs, ranks, sequence = defaultdict(list), defaultdict(int), 0
    for pattern, times in plan:
        for i, n in pattern:
            runs[int(sizes[i])].append((ranks[i], n, sequence))
            ranks[i] += n * times
        sequence += times
    served = spark.sparkContext.broadcast(({c: np.array(rs, np.int64).T for c, rs in runs.items()}, items))  # as long as patterns and lengths
    salts = spark.createDataFrame([(n, -(-k // RANKED_ROWS)) for n, k in counts.items()], "length long, _salts int")  # a row a length
    salted = made.join(F.broadcast(salts), "length").withColumn("_salt", F.pmod(F.xxhash64("_key", "start", "ids_crc32", "_row"), F.col("_salts")).cast("int")).drop("_salts")
    up_to = W.partitionBy("length").orderBy("_salt").rowsBetween(W.unboundedPreceding, -1)
    bases = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n")).select("length", "_salt", F.coalesce(F.sum("_n").over(up_to), F.lit(0)).alias("_base"))  # a row for RANKED_ROWS pieces
    ranked = (
        salted.withColumn("_rank", F.row_number().over(W.partitionBy("length", "_salt").orderBy("_key", "start", "ids_crc32", "_row")) - 1)
        .join(bases, ["length", "_salt"]).withColumn("_rank", F.col("_rank") + F.col("_base"))
    )
    kind = docs.schema[key].dataType.simpleString()

    def place(batches):
        runs, items = served.value
        for batch in batches:
            at = {n: i for i, n in enumerate(batch.schema.names)}
            rank, lengths = batch.column(at["_rank"]).to_numpy(), batch.column(at["length"]).to_numpy()
            group, item, turn, out = (np.zeros(len(rank), np.int64) for _ in range(4))
            for n in np.unique(lengths):
                each, full, (c, base), (last_c, last) = items[int(n)]
                rows = np.flatnonzero(lengths == n)
                whole = rank[rows] < full * each
                group[rows] = np.where(whole, c, last_c)
                item[rows] = np.where(whole, base + rank[rows] // each, last)
                turn[rows] = np.where(whole, rank[rows] % each, rank[rows] - full * each)
            for c in np.unique(group):
                rows = np.flatnonzero(group == c)
                begin, each, seq = runs[int(c)]
                k = np.searchsorted(begin, item[rows], "right") - 1
                out[rows] = seq[k] + (item[rows] - begin[k]) // each[k]
            keep = ["_key", "start", "length", "ids_crc32", "doc_tokens"]
            yield pa.RecordBatch.from_arrays([*(batch.column(at[n]) for n in keep), *map(pa.array, (group, item, turn, out))], names=[*keep, "_class", "_item", "_turn", "sequence_id"])

    placed = arrow_map(ranked, place, f"_key {kind}, {PIECES}, _class long, _item long, _turn long, sequence_id long")
    before = W.partitionBy("sequence_id").orderBy(F.desc("_class"), "_item", "length", "_turn").rowsBetween(W.unboundedPreceding, -1)
    out = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    placed = placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long"))
    return placed.select(F.col("_key").alias(key), *(F.col(c).alias(n) for c, n in zip(out, fresh([key], *out))))
