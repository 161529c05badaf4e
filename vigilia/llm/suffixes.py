"""Removal of long repeated byte strings by prefix doubling over sampled positions.

Prefix doubling ranks positions by pairs of ranks at growing offsets, until a
rank is unique or the strings are long enough. All positions of a corpus are
too many to sort eight times, so each window of `length` bytes is ranked at one
position inside it: where the hash of a short gram is least. Equal windows
choose alike, so their positions, here called anchors, share the gram, and each
window start p is an offset o = a - p before exactly one anchor a. An anchor
serves a run of offsets, 64 on average at 200 bytes.

The offsets form a cell of 128, cut into smaller cells round by round. All
windows of a cell share a core around the anchor and lie inside its context.
Anchors are sorted by (rank of the core, rank of the context):

* where a core stands alone, no window of the cell is repeated;
* where a context stands twice, all of them are; of such equals one goes on as
  a witness for others that share the core alone;
* the rest is cut into smaller cells. Their cores are ranked by the pair of the
  old core's rank and the bytes that the core grows by, to the left and the
  right. The last cells are single offsets, whose core is the window itself.

Ranks are 64-bit hashes; a removal rests on two of different functions. Equal
texts are one text under one hash. Rows go by ranges of their ranks, so a
string that a third of all texts hold is dealt over many tasks; what a task
cannot see at its borders is taken to need another round.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilia.llm.common import arrow_map, cut, fresh
from vigilia.llm.textbytes import _BYTE, U64, mix, powers, slices, text_buffers

LENGTH = 200
MOST_OFFSETS = 128
BLOCK = 1 << 20  # window starts of a text that are hashed at once
SEEN_TEXTS = 100_000  # text hashes a task remembers, to pass over third copies
SETTLED, OPEN, WITNESS = 0, 1, 2
ROWS = "name long, full long, h long, at long"
CELLS = "o int, witness boolean, before binary, after binary"
_OTHER_BYTE = mix(_BYTE + U64(0xD1B54A32D192ED03))  # of the second hash
_LEFT, _RIGHT, _PLACE = U64(0xA0761D6478BD642F), U64(0xE7037ED1A0B428DB), U64(0x8EBC6AF09C88C6E3)


def cell_sizes(length: int) -> list[int]:
    """How many offsets a cell has in each round: a power of two at most two thirds of the length, quarters of it, then 1."""
    size = 1
    while size * 2 <= min(MOST_OFFSETS, length * 2 // 3):
        size *= 2
    out = [size]
    while out[-1] > 1:
        out.append(out[-1] // 4 if out[-1] > 8 else 1)
    return out


def _pack(a: np.ndarray, low: np.ndarray, high: np.ndarray, check: np.ndarray) -> np.ndarray:
    """Anchor, its least and greatest offset and 18 more bits of the text's hash in 63 bits."""
    return a << 32 | low << 25 | high << 18 | check


def _unpack(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return at >> 32, at >> 25 & 127, at >> 18 & 127


class _Sums:
    """Hashes of any substrings of one byte array."""

    def __init__(self, data: np.ndarray, values: np.ndarray):
        up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, U64)
        np.cumsum(values[data] * up[: len(data)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts])


def anchors(data: np.ndarray, at: np.ndarray, length: int) -> dict[str, np.ndarray]:
    """Of rows (bytes, offsets): each anchor's row, place in it, least and greatest offset, rank of its core and of its context (0: it does not fit)."""
    size = cell_sizes(length)[0]
    gram, parts, n = length - size + 1, [], len(data)
    for p0 in range(0, max(0, n - length + 1), BLOCK):
        p1 = min(p0 + BLOCK, n - length + 1)  # window starts p0 to p1 - 1
        base, top = max(0, p0 - size), min(n, p1 + length + size)
        piece = data[base:top]
        first = _Sums(piece, _BYTE)
        start = np.arange(p0 - base, p1 - base + size - 1)
        grams = mix((first.sums[start + gram] - first.sums[start]) * first.down[start])
        least = grams & ~U64((1 << 22) - 1) | np.arange(len(grams), dtype=U64)  # ties go to the left one
        step = 1
        while step < size:
            least = np.minimum(least[:-step], least[step:])
            step *= 2
        stop = at[np.searchsorted(at, np.arange(p0, p1), "right")]
        p = np.flatnonzero(np.arange(p0, p1) + length <= stop)
        if not len(p):
            continue
        chosen = (least[p] & U64((1 << 22) - 1)).astype(np.int64)
        new = np.ones(len(p), bool)
        new[1:] = (chosen[1:] != chosen[:-1]) | (p[1:] != p[:-1] + 1)
        heads = np.flatnonzero(new)
        tails = np.append(heads[1:], len(p)) - 1
        place = chosen[heads]
        a = place + p0
        row = np.searchsorted(at, a, "right") - 1
        low, high = a - (p[tails] + p0), a - (p[heads] + p0)
        wide = (a - (size - 1) >= at[row]) & (a + length <= at[row + 1])
        full = np.zeros(len(a), U64)
        full[wide] = _Sums(piece, _OTHER_BYTE).of(a[wide] - (size - 1) - base, a[wide] + length - base) | U64(1)
        part = {"row": row, "a": a - at[row], "low": low, "high": high, "name": grams[place], "full": full}
        if parts and parts[-1]["row"][-1] == row[0] and parts[-1]["a"][-1] == part["a"][0]:  # a run that the block cuts
            part["high"][0] = parts[-1]["high"][-1]
            parts[-1] = {k: v[:-1] for k, v in parts[-1].items()}
            if not len(parts[-1]["a"]):
                parts.pop()
        parts.append(part)
    if not parts:
        return {k: np.zeros(0, np.int64) for k in ("row", "a", "low", "high", "name", "full")}
    return {k: np.concatenate([x[k] for x in parts]) for k in parts[0]}


def _scan(texts: DataFrame, length: int) -> DataFrame:
    """Anchors of all texts. `texts` has (h, check, text)."""

    def run(batches):
        seen: dict[int, int] = {}
        for batch in batches:
            keep = []
            for h in batch.column("h").to_pylist():
                seen[h] = seen.get(h, 0) + 1
                keep.append(seen[h] < 3)
            if len(seen) > SEEN_TEXTS:
                seen.clear()
            batch = batch.filter(pa.array(keep))
            h, check = batch.column("h").to_numpy(), batch.column("check").to_numpy()
            for lo, _, data, at in slices(batch, "text"):
                got = anchors(data, at, length)
                if len(got["row"]):
                    row = got["row"] + lo
                    out = [got["name"].view(np.int64), got["full"].view(np.int64), h[row], _pack(got["a"], got["low"], got["high"], check[row])]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["name", "full", "h", "at"])

    return arrow_map(texts, run, ROWS)


def _ranked(rows: DataFrame) -> DataFrame:
    """`kind` of each row: SETTLED, OPEN or WITNESS; rows whose core stands alone go. One sort by ranges of the ranks.

    Rows that are equal up to `o` are copies in equal texts, and repeat each
    other. The first and last rows of a task are not known to be alone.
    """
    keys = ["name", "full", "h", "at"] + (["o"] if "o" in rows.columns else [])
    rest = [c for c in rows.columns if c not in ("full", "witness")]

    def run(batches):
        # `held` is the last decided row and the next one, which waits for its successor; `decided` of them are decided.
        # `since` tells whether the decided one's run of equals came after another row of its name.
        held, decided, since = None, 0, True
        for batch in _with_end(batches):
            parts = [x for x in (held, batch) if x is not None]
            if not parts:
                return
            table = pa.Table.from_batches(parts).combine_chunks()
            n = table.num_rows
            hi = n if batch is None else n - 1
            if not n:
                continue
            col = {k: table.column(k).to_numpy() for k in keys}
            same, equal = np.ones(n + 1, bool), np.zeros(n + 1, bool)  # rows i - 1 and i: of one name, and repeating each other
            same[1:-1] = col["name"][1:] == col["name"][:-1]
            twin = np.logical_and.reduce([col[k][1:] == col[k][:-1] for k in keys])
            equal[1:-1] = same[1:-1] & (twin | (col["full"][1:] == col["full"][:-1]) & (col["full"][1:] != 0))
            witness = table.column("witness").to_numpy() if "witness" in table.schema.names else np.zeros(n, bool)
            first = ~equal[:-1]
            if decided:
                first[0] = False
            start = np.maximum.accumulate(np.where(first, np.arange(n), -1))
            follows = np.where(start >= 0, same[:-1][np.maximum(start, 0)], since)
            repeated, now = equal[:-1] | equal[1:], np.zeros(n, bool)
            now[decided:hi] = True
            shares = now & ~repeated & (same[:-1] | same[1:])
            stands = now & repeated & ~equal[1:] & (follows | same[1:])  # the last of its equals stands for them
            chosen = [np.flatnonzero(x) for x in (now & repeated & ~witness & ~np.append(False, twin), shares & ~witness, shares & witness | stands)]
            got = table.select(rest).take(pa.array(np.concatenate(chosen)))
            if got.num_rows:
                yield from got.append_column("kind", pa.array(np.repeat(np.array([SETTLED, OPEN, WITNESS], np.int32), [len(x) for x in chosen]))).combine_chunks().to_batches()
            if batch is not None:
                keep = max(0, hi - 1)
                held, decided, since = table.slice(keep).combine_chunks().to_batches()[0], hi - keep, bool(follows[keep])

    kinds = dict(rows.dtypes)
    return arrow_map(rows.repartitionByRange(*keys).sortWithinPartitions(*keys), run, ", ".join(f"{c} {kinds[c]}" for c in rest) + ", kind int")


def _with_end(batches):
    """The batches, then None."""
    yield from batches
    yield None


def _taken(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The substrings as a binary array."""
    size = ends - starts
    stop = np.concatenate([[0], np.cumsum(size)])
    index = np.arange(stop[-1]) + np.repeat(starts - stop[:-1], size)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(stop.astype(np.int32).tobytes()), pa.py_buffer(data[index].tobytes())])


def _contexts(open_rows: DataFrame, texts: DataFrame, length: int) -> DataFrame:
    """The open anchors and witnesses with the bytes before and after their cores, as far as their texts go."""
    size = cell_sizes(length)[0]
    wanted = open_rows.groupBy("h", (F.col("at").bitwiseAND(F.lit((1 << 18) - 1))).alias("check")).agg(F.collect_list(F.struct("at", "name", "kind")).alias("anchors"))

    def run(batches):
        for batch in batches:
            lists = batch.column("anchors")
            for lo, hi, data, at in slices(batch, "text"):
                some = lists.slice(lo, hi - lo)
                inner, counts = some.flatten(), np.diff(some.offsets.to_numpy())
                row = np.repeat(np.arange(hi - lo), counts)
                where = inner.field("at").to_numpy()
                a = (where >> 32) + at[row]
                before = _taken(data, np.maximum(a - (size - 1), at[row]), a)
                core = a + length - size + 1
                after = _taken(data, core, np.minimum(core + size - 1, at[row + 1]))
                h = batch.column("h").slice(lo, hi - lo).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([h, inner.field("at"), inner.field("name"), pa.array(inner.field("kind").to_numpy() == WITNESS), before, after], names=["h", "at", "name", "witness", "before", "after"])

    found = arrow_map(texts.join(wanted, ["h", "check"]).select("h", "text", "anchors"), run, "h long, at long, name long, witness boolean, before binary, after binary")
    found = found.groupBy("h", "at", "name", "witness").agg(F.first("before").alias("before"), F.first("after").alias("after"))  # equal texts give a row each
    return found.select("name", "h", "at", F.lit(0).alias("o"), "witness", "before", "after")


def _smaller(cells: DataFrame, size: int, small: int) -> DataFrame:
    """The cells of `small` offsets in each cell of `size`, ranked by pairs: the old core's rank and the bytes that it grows by."""

    def run(batches):
        for batch in batches:
            name, at, o = (batch.column(c).to_numpy() for c in ("name", "at", "o"))
            o, witness = o.astype(np.int64), batch.column("witness").to_numpy(zero_copy_only=False)
            _, low, high = _unpack(at)
            (left, l_at), (right, r_at) = (text_buffers(_as_text(batch.column(c))) for c in ("before", "after"))
            sums = [[_Sums(x, t) for t in (_BYTE, _OTHER_BYTE)] for x in (left, right)]
            for j in range(size // small):
                y = o + j * small
                grow_l, grow_r = j * small, size - small - j * small
                l_in, r_in = l_at[1:] - grow_l, r_at[:-1] + grow_r  # borders of the new core
                fits = (l_in >= l_at[:-1]) & (r_in <= r_at[1:]) & (witness | (y <= high) & (y + small - 1 >= low))
                i = np.flatnonzero(fits)
                if not len(i):
                    continue
                l_out, r_out = np.maximum(l_in[i] - (small - 1), l_at[i]), np.minimum(r_in[i] + small - 1, r_at[i + 1])
                seed = mix(name[i].view(U64) + _PLACE * (y[i] + 1).astype(U64))
                core = mix(seed + _LEFT * sums[0][0].of(l_in[i], l_at[i + 1]) + _RIGHT * sums[1][0].of(r_at[i], r_in[i]))
                full = mix(seed ^ (_LEFT * sums[0][1].of(l_out, l_at[i + 1]) + _RIGHT * sums[1][1].of(r_at[i], r_out))) | U64(1)
                full[(l_in[i] - l_out < small - 1) | (r_out - r_in[i] < small - 1)] = 0
                out = [pa.array(core.view(np.int64)), pa.array(full.view(np.int64)), batch.column("h").take(pa.array(i)), pa.array(at[i]), pa.array(y[i].astype(np.int32)), pa.array(witness[i]), _taken(left, l_out, l_in[i]), _taken(right, r_in[i], r_out)]
                yield pa.RecordBatch.from_arrays(out, names=["name", "full", "h", "at", "o", "witness", "before", "after"])

    return arrow_map(cells, run, f"{ROWS}, {CELLS}")


def _as_text(column: pa.Array) -> pa.Array:
    """A binary column's buffers under the type that `text_buffers` reads."""
    return pa.Array.from_buffers(pa.string(), len(column), column.buffers(), offset=column.offset)


def _spans(settled: DataFrame, size: int) -> DataFrame:
    """(h, check, lo, hi): the first and last start of repeated windows that a settled cell stands for."""
    a, low, high = F.shiftright("at", 32), F.shiftright("at", 25).bitwiseAND(F.lit(127)), F.shiftright("at", 18).bitwiseAND(F.lit(127))
    return settled.select("h", F.col("at").bitwiseAND(F.lit((1 << 18) - 1)).alias("check"), (a - F.least(high, F.col("o") + size - 1)).alias("lo"), (a - F.greatest(low, F.col("o"))).alias("hi"))


def repeated_spans(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """(h, check, lo, hi): all starts of windows that start elsewhere too, as runs. `texts` has (h, check, text), equal texts several times."""
    sizes = cell_sizes(length)
    now = cut(_ranked(_scan(texts, length)))
    out = [_spans(now.where(F.col("kind") == SETTLED).withColumn("o", F.lit(0)), sizes[0])]
    if len(sizes) == 1:
        return out[0]
    cells = _contexts(now.where(F.col("kind") != SETTLED), texts, length)
    for size, small in zip(sizes[:-1], sizes[1:]):
        cells = _smaller(cells, size, small)
        if small > 1:
            now = cut(_ranked(cells))
            out.append(_spans(now.where(F.col("kind") == SETTLED), small))
            cells = now.where(F.col("kind") != SETTLED).withColumn("witness", F.col("kind") == WITNESS)
    cells = cut(cells.select("name", "full", "h", "at", "o", "witness"))
    twice = cells.groupBy("name", "full").agg(F.count("*").alias("n")).where("n > 1")
    out.append(_spans(cells.where(~F.col("witness")).join(twice, ["name", "full"], "left_semi"), 1))
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole


def drop_repeats(docs: DataFrame, key: str, text: str, length: int = LENGTH, kept: bool = False) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256) per row, with `kept` also what is left, as binary column `kept`.

    A byte goes if a string of `length` bytes over it starts anywhere else, in
    the same text or another. Null texts are empty; texts under `length` bytes
    keep all. Rows that repeat, or have equal or null keys, are texts of their
    own, so both copies of a long text go. An empty table gives no rows. Other
    columns are ignored.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    slim = docs.select(F.col(key).alias("_key"), body.alias("text"), F.xxhash64(body).alias("h"), F.crc32(body.cast("binary")).bitwiseAND(F.lit((1 << 18) - 1)).alias("check"))
    spans = repeated_spans(slim.select("h", "check", "text"), length).groupBy("h", "check").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            data, at = text_buffers(batch.column("text"))
            raw, bounds, lists, rows = data.tobytes(), at.tolist(), batch.column("spans"), []
            inner, stops = lists.flatten(), np.concatenate([[0], np.cumsum(np.where(lists.is_valid().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy()), 0))]).tolist()
            lows, highs = inner.field("lo").to_numpy(), inner.field("hi").to_numpy() + length
            for i, (s, e) in enumerate(zip(bounds[:-1], bounds[1:])):
                f, t = stops[i], stops[i + 1]
                if f == t:
                    left, removed, count = raw[s:e], 0, 0
                else:
                    order = np.argsort(lows[f:t], kind="stable")
                    lo, hi = lows[f:t][order], np.maximum.accumulate(highs[f:t][order])
                    new = np.append(True, lo[1:] > hi[:-1])
                    lo, hi = lo[new], hi[np.append(np.flatnonzero(new)[1:], len(new)) - 1]
                    left = b"".join(raw[s + x : s + y] for x, y in zip([0, *hi.tolist()], [*lo.tolist(), e - s]))
                    removed, count = int((hi - lo).sum()), len(lo)
                rows.append((e - s, removed, count, hashlib.sha256(left).hexdigest(), *([left] if kept else [])))
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column("_key"), *(pa.array(c) for c in zip(*rows))], names=["_key", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if kept else [])])

    joined = slim.join(spans, ["h", "check"], "left").select("_key", "text", "spans")
    out = arrow_map(joined, run, f"_key {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if kept else ""))
    names = [c for c in out.columns if c != "_key"]
    return out.select(F.col("_key").alias(key), *(F.col(c).alias(n) for c, n in zip(names, fresh([key], *names))))
