"""Alignment of two tokenizers' tokens over the same bytes.

Both token sequences of a text are arrays of byte ends. Where the tokens at
(i, j) end at the same byte for a stretch, the arrays are equal at the shift
j - i: blocks of doubling length are compared at that shift, so a one-to-one
stretch is jumped over in steps that grow. At the first difference the group
is resolved alone, by advancing the side that is behind until both end at one
byte, and the shift becomes that of the new place.

Text is cut into units before it is tokenized: a unit starts at a space after
a visible character, where both tokenizers always start a token. A worker
aligns each distinct unit once, many new ones in one pair of end arrays, and
remembers its ids, groups and links; a text's figures are sums over its units.

The counts of id pairs, in how many texts a pair is linked, are taken over all
texts in a first pass. A second pass meets them in parts by id of the first
tokenizer, each of a bounded number of pairs.
"""

from __future__ import annotations

import functools
import hashlib
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilia.llm.common import arrow_map, cut, fresh
from vigilia.llm.textbytes import U64, HashIndex, row_sums, slices, word_hashes

MEMO_UNITS = 800_000  # units whose alignment a worker remembers, of some 200 bytes each
MEMO_LINKS = 6_000_000  # and their links together
JOINED = 256  # new units that are tokenized as one text
PART_PAIRS = 4_000_000  # linked id pairs that a pass broadcasts, 16 bytes each
TASK_PAIRS = 1_000_000  # id pairs that a task counts before it hands them on
B_IDS = 1 << 16  # more than the ids of the second tokenizer
FIRST_PROBE = 4

FIGURES = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def diagonal_groups(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of two rising arrays of ends with the same last one: the places after each group's last token, in a and in b.

    Every group ends where both arrays have the same end and holds no such place inside.
    """
    n, m = len(a), len(b)
    ga, gb = [], []  # stretches and single places
    left, right = a.tolist(), b.tolist()
    i = j = 0
    while i < n:
        step, run = FIRST_PROBE, 0
        while True:  # equal blocks of doubling length at the shift j - i
            stop = min(step, n - i - run, m - j - run)
            if stop <= 0:
                break
            if step <= 64:
                x, y = left[i + run : i + run + stop], right[j + run : j + run + stop]
                if x == y:
                    run, step = run + stop, 2 * step
                    continue
                k = 0
                while x[k] == y[k]:
                    k += 1
            else:
                differ = a[i + run : i + run + stop] != b[j + run : j + run + stop]
                k = int(differ.argmax())
                if not differ[k]:
                    run, step = run + stop, 2 * step
                    continue
            run += k
            break
        if run:
            ga.append((i + 1, run))
            gb.append((j + 1, run))
            i, j = i + run, j + run
            if i >= n:
                break
        x, y = left[i], right[j]
        while x != y:  # an irregular group, up to the next common end
            if x < y:
                i += 1
                x = left[i]
            else:
                j += 1
                y = right[j]
        i, j = i + 1, j + 1
        ga.append((i, 1))
        gb.append((j, 1))
    out = []
    for g in (ga, gb):
        first, size = np.array(g, np.int64).reshape(-1, 2).T
        stop = np.cumsum(size)
        out.append(np.repeat(first - (stop - size), size) + np.arange(stop[-1] if len(stop) else 0))
    return out[0], out[1]


def _token_bytes_a(tokenizer) -> list[bytes]:
    """The bytes of each id of a byte-level tokenizer: its characters stand for bytes, printable Latin ones for themselves, the others for 256 and up."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [x for x in range(256) if x not in set(shown)]
    byte = {chr(x): x for x in shown} | {chr(256 + i): x for i, x in enumerate(rest)}
    special = {i for i, t in tokenizer.get_added_tokens_decoder().items() if t.special}
    out = [b""] * tokenizer.get_vocab_size()
    for token, i in tokenizer.get_vocab().items():
        out[i] = b"" if i in special else bytes(byte[c] for c in token)
    return out


def _token_bytes_b(pieces) -> list[bytes]:
    """The bytes of each piece: UTF-8 with U+2581 as a space, byte pieces as their byte."""
    out = []
    for i in range(pieces.get_piece_size()):
        piece = pieces.id_to_piece(i)
        out.append(bytes([int(piece[3:5], 16)]) if pieces.is_byte(i) else piece.replace("▁", " ").encode())
    return out


#: Bytes after which a space starts a unit: visible ASCII ones, and those that end a character of two bytes.
_VISIBLE = np.zeros(256, bool)
_VISIBLE[0x21:0x7F] = True
_TWO = np.zeros(256, bool)
_TWO[0xC3:0xE0] = True  # first bytes; 0xC2 also starts white space


def units(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all units and each row's first unit (one more than rows). A space that ends its row starts none: the second tokenizer would see no text after the space that it adds itself."""
    n = len(data)
    opens = np.zeros(n + 1, bool)
    opens[at] = True
    if n > 1:
        space = np.flatnonzero(data[1:] == 0x20) + 1
        space = space[~opens[space + 1]]
        before = data[space - 1]
        two = (before >= 0x80) & _TWO[data[np.maximum(space - 2, 0)]] & (space >= 2)
        opens[space[_VISIBLE[before] | two]] = True
    edges = np.flatnonzero(opens)
    starts, ends = edges[:-1], edges[1:]
    return starts, ends, np.searchsorted(starts, at)


class Aligner:
    """Alignments of units, remembered by a hash, their length and first bytes."""

    def __init__(self, path_a: str, path_b: str, most: int = MEMO_UNITS, links: int = MEMO_LINKS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        self.bytes_a, self.bytes_b = _token_bytes_a(self.a), _token_bytes_b(self.b)
        self.size_a, self.size_b = (np.array([len(t) for t in x], np.int64) for x in (self.bytes_a, self.bytes_b))
        if any(" " in t[1:].lstrip(" ") for t in (self.b.id_to_piece(i).replace("▁", " ") for i in range(self.b.get_piece_size()))):
            raise ValueError("a piece of the second tokenizer goes on after a space: its units cannot be told apart")
        if self.b.get_piece_size() > B_IDS:
            raise ValueError(f"the second tokenizer has more than {B_IDS} ids")
        shown = [str(i).encode() for i in range(max(len(self.bytes_a), len(self.bytes_b)))]
        self.decimal, self.decimal_at = np.frombuffer(b"".join(shown), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in shown])])
        self.code = np.uint32 if len(self.bytes_a) <= 1 << 16 else np.int64
        self.most, self.links = most, links
        self._empty()

    def _empty(self) -> None:
        self.keys, self.checks, self.sound = np.zeros(0, U64), np.zeros(0, U64), np.zeros(0, bool)
        self.figures = np.zeros((0, 4), np.int32)  # n_a, n_b, n_groups, n_links
        self.pairs, self.first = np.zeros(0, self.code), np.zeros(1, np.int64)  # linked pairs of each unit, repeats included
        self.text, self.text_at = np.zeros(0, np.uint8), np.zeros(1, np.int64)  # groups as text, each with a semicolon after it
        self.old, self.new, self.border = HashIndex(self.keys), HashIndex(self.keys), 0

    def _find(self, keys: np.ndarray) -> np.ndarray:
        place = self.old.find(keys).astype(np.int64)
        left = np.flatnonzero(place < 0)
        got = self.new.find(keys[left])
        place[left] = np.where(got >= 0, got + self.border, -1)
        return place

    def _encode(self, raws: list[bytes]) -> list[list[list[int]]]:
        """Ids of byte strings that start with a space, by both tokenizers; the second adds that space itself."""
        texts = [r.decode("utf-8", "replace") for r in raws]
        return [[x.ids for x in self.a.encode_batch_fast(texts, add_special_tokens=False)], self.b.encode([t[1:] for t in texts], num_threads=1)]

    def encoded(self, raws: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """By both tokenizers: the ids of all units one after another, and how many each unit has.

        Units that end in a visible character are tokenized many at a time as
        one text, which is told apart again where tokens end; the others alone.
        """
        plain = [i for i, r in enumerate(raws) if (0x21 <= r[-1] < 0x7F or len(r) > 1 and r[-1] >= 0x80 and 0xC3 <= r[-2] < 0xE0) and b"\xe2\x96\x81" not in r]
        chunks = [plain[i : i + JOINED] for i in range(0, len(plain), JOINED)]
        order, flat, count = [], ([], []), ([], [])
        alone = sorted({*range(len(raws))} - {*plain})
        for c, *both in zip(chunks, *self._encode([b"".join([raws[i] for i in c]) for c in chunks])):
            stops = np.cumsum([len(raws[i]) for i in c])
            parts = []
            for ids, size in zip(both, (self.size_a, self.size_b)):
                ids = np.array(ids, np.int64)
                ends = np.cumsum(size[ids])
                at = np.searchsorted(ends, stops)
                if len(ends) and ends[-1] == stops[-1] and (ends[at] == stops).all():
                    parts.append((ids, np.diff(at, prepend=-1)))
            if len(parts) < 2:
                alone += c  # a unit here has other bytes than its text
                continue
            order += c
            for k, (ids, n) in enumerate(parts):
                flat[k].append(ids)
                count[k].append(n)
        order = np.array(order + alone, np.int64)
        back, out = np.argsort(order), []
        for k, got in enumerate(self._encode([raws[i] for i in alone])):
            ids = np.concatenate([np.zeros(0, np.int64), *flat[k], *(np.array(x, np.int64) for x in got)])
            n = np.concatenate([np.zeros(0, np.int64), *count[k], np.array([len(x) for x in got], np.int64)])
            out.append((ids[_exploded(np.concatenate([[0], np.cumsum(n)]), back)[0]], n[back]))
        return out

    def aligned(self, raws: list[bytes]) -> tuple[np.ndarray, ...]:
        """Of byte strings that start with a space: sound, figures, linked pairs, each one's first pair (one more), the groups as text and each one's first byte of it (one more)."""
        both, sound, joined = self.encoded(raws), np.ones(len(raws), bool), b"".join(raws)
        stops = np.cumsum([len(r) for r in raws])
        for (flat, count), table, size in zip(both, (self.bytes_a, self.bytes_b), (self.size_a, self.size_b)):
            ends = np.concatenate([[0], np.cumsum(size[flat])])[np.cumsum(count)]
            if (ends == stops).all() and b"".join(map(table.__getitem__, flat.tolist())) == joined:
                continue
            first = np.cumsum(count) - count
            sound &= np.array([b"".join(map(table.__getitem__, flat[f : f + n].tolist())) == r for f, n, r in zip(first.tolist(), count.tolist(), raws)], bool)
        if not sound.all():
            both = [(flat[np.repeat(sound, count)], np.where(sound, count, 0)) for flat, count in both]
        (flat_a, count_a), (flat_b, count_b) = both
        stop_a, stop_b = diagonal_groups(np.cumsum(self.size_a[flat_a]), np.cumsum(self.size_b[flat_b]))  # units start and end at common places
        per_a, per_b = np.diff(stop_a, prepend=0), np.diff(stop_b, prepend=0)
        from_a, from_b = stop_a - per_a, stop_b - per_b
        group_at = np.searchsorted(stop_a, np.concatenate([[0], np.cumsum(count_a)]), "right")  # each unit's first group
        link_at = np.concatenate([[0], np.cumsum(per_a * per_b)])
        g = np.repeat(np.arange(len(per_a)), per_a * per_b)
        k = np.arange(link_at[-1]) - link_at[:-1][g]
        pairs = flat_a[from_a[g] + k // per_b[g]] * B_IDS + flat_b[from_b[g] + k % per_b[g]]
        figures = np.stack([count_a, count_b, np.diff(group_at), np.diff(link_at[group_at])], axis=1).astype(np.int32)
        # Of each group the ids of a, then those of b, each with the sign after it.
        ids, signs = np.zeros(len(flat_a) + len(flat_b), np.int64), np.full(len(flat_a) + len(flat_b), ord(","), np.uint8)
        group_a, group_b = np.repeat(np.arange(len(per_a)), per_a), np.repeat(np.arange(len(per_b)), per_b)
        ids[np.arange(len(flat_a)) + from_b[group_a]] = flat_a
        ids[np.arange(len(flat_b)) + stop_a[group_b]] = flat_b
        signs[stop_a + from_b - 1], signs[stop_a + stop_b - 1] = ord("|"), ord(";")
        at, token = _exploded(self.decimal_at, ids)
        wide = np.concatenate([[0], np.cumsum(np.diff(self.decimal_at)[ids] + 1)])
        text = np.zeros(wide[-1], np.uint8)
        text[np.arange(len(at)) + token] = self.decimal[at]
        text[wide[1:] - 1] = signs
        return sound, figures, pairs.astype(self.code), link_at[group_at], text, wide[np.concatenate([[0], stop_a + stop_b])[group_at]]

    def _learn(self, keys: np.ndarray, checks: np.ndarray, raws: list[bytes]) -> None:
        sound, figures, pairs, first, text, text_at = self.aligned(raws)
        self.first = np.concatenate([self.first, self.first[-1] + first[1:]])
        self.pairs = np.concatenate([self.pairs, pairs])
        self.keys, self.checks = np.concatenate([self.keys, keys]), np.concatenate([self.checks, checks])
        self.sound, self.figures = np.concatenate([self.sound, sound]), np.concatenate([self.figures, figures])
        self.text, self.text_at = np.concatenate([self.text, text]), np.concatenate([self.text_at, self.text_at[-1] + text_at[1:]])
        if len(self.keys) - self.border > max(4096, self.border // 4):
            self.border, self.old = len(self.keys), HashIndex(self.keys)
        self.new = HashIndex(self.keys[self.border :])

    def places(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The remembered unit of every unit of the rows, and each row's first. Rows start with a space."""
        starts, ends, first = units(data, at)
        keys, size = word_hashes(data, starts, ends), ends - starts
        eight = np.ndarray(len(data), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]).tobytes(), strides=(1,))[starts] if len(data) else np.zeros(0, U64)
        eight = eight & ((U64(1) << (U64(8) * np.minimum(size, 7).astype(U64))) - U64(1) | np.where(size > 7, U64(0xFF << 56), U64(0)))
        checks = eight * U64(31) + size.astype(U64)
        if len(self.keys) > self.most or self.first[-1] > self.links:
            self._empty()
        place = self._find(keys)
        missing = np.flatnonzero(place < 0)
        if len(missing):
            new, which = np.unique(keys[missing], return_index=True)
            which, raw = missing[which], data.tobytes()
            self._learn(new, checks[which], [raw[a:b] for a, b in zip(starts[which].tolist(), ends[which].tolist())])
            place[missing] = self._find(keys[missing])
        clash = np.flatnonzero(self.checks[place] != checks)
        if len(clash):  # units of equal hashes are remembered once more, under no key
            raw, base = data.tobytes(), len(self.keys)
            self._learn(np.zeros(len(clash), U64), checks[clash], [raw[starts[i] : ends[i]] for i in clash.tolist()])
            place[clash] = base + np.arange(len(clash))
        return place, first


@functools.lru_cache(maxsize=1)
def _aligner(path_a: str, path_b: str, most: int, links: int) -> Aligner:
    """One per worker process, so that what a task has learned serves the next."""
    return Aligner(path_a, path_b, most, links)


def _spaced(batch: pa.RecordBatch, column: str):
    """Slices of a batch of texts with a space before each; empty and null rows stay empty."""
    for lo, hi, data, at in slices(batch, column):
        n, full = len(at) - 1, np.diff(at) > 0
        out = np.full(len(data) + int(full.sum()), 0x20, np.uint8)
        shift = np.cumsum(full)
        starts = np.concatenate([[0], at[1:] + shift])
        out[np.arange(len(data)) + np.repeat(shift, np.diff(at))] = data
        yield lo, hi, out, starts[: n + 1]


def _exploded(first: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places first[w]..first[w + 1] for each w in which, one after another, and to which entry of which each belongs."""
    size = first[which + 1] - first[which]
    stop = np.cumsum(size)
    owner = np.repeat(np.arange(len(which)), size)
    return first[which][owner] + np.arange(stop[-1] if len(stop) else 0) - (stop - size)[owner], owner


def _sound_rows(memo: Aligner, place: np.ndarray, first: np.ndarray) -> np.ndarray:
    return row_sums(~memo.sound[place], first) == 0


def pair_counts(docs: DataFrame, text: str, path_a: str, path_b: str, most: int = MEMO_UNITS, links: int = MEMO_LINKS) -> DataFrame:
    """(pair, docs): in how many texts an id of the first tokenizer and one of the second are linked. Pairs are a * 65,536 + b."""

    def run(batches):
        memo = _aligner(path_a, path_b, most, links)
        held, waiting, size = (np.zeros(0, np.int64), np.zeros(0, np.int64)), [], 0

        def merged():
            got, back = np.unique(np.concatenate([held[0], *waiting]), return_inverse=True)
            weights = np.concatenate([held[1], *(np.ones(len(w), np.int64) for w in waiting)])
            return got, np.bincount(back, weights, len(got)).astype(np.int64)

        for batch in batches:
            for _, _, data, at in _spaced(batch, "_text"):
                place, first = memo.places(data, at)
                row = np.repeat(np.arange(len(first) - 1), np.diff(first))
                good = _sound_rows(memo, place, first)[row]
                seen = np.unique(row[good] * (1 << 32) + place[good])  # each unit once a row
                which, owner = _exploded(memo.first, seen & ((1 << 32) - 1))
                pairs, index = np.unique(memo.pairs[which], return_inverse=True)
                each = np.unique((seen >> 32)[owner] * len(pairs) + index)  # each pair once a row
                waiting.append(pairs[each % max(1, len(pairs))].astype(np.int64))
                size += len(each)
                if size > TASK_PAIRS:
                    held, waiting, size = merged(), [], 0
                    if len(held[0]) > TASK_PAIRS:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], names=["pair", "docs"])
                        held = np.zeros(0, np.int64), np.zeros(0, np.int64)
        held = merged()
        if len(held[0]):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], names=["pair", "docs"])

    return arrow_map(docs.select(F.col(text).alias("_text")), run, "pair long, docs long").groupBy("pair").agg(F.sum("docs").alias("docs"))


def _parts(counts: DataFrame, most: int) -> list[tuple[int, int]]:
    """Ranges of the first tokenizer's ids that hold about `most` pairs each. At most as many rows as that vocabulary has ids come to the driver."""
    sizes = sorted((r.a, r.n) for r in counts.groupBy(F.shiftright("pair", 16).alias("a")).agg(F.count("*").alias("n")).collect())
    out, start, held = [], 0, 0
    for a, n in sizes:
        if held and held + n > most:
            out.append((start, a))
            start, held = a, 0
        held += n
    return [*out, (start, 1 << 31)]


def align_corpus(docs: DataFrame, key: str, text: str, path_a: str, path_b: str, memo_units: int = MEMO_UNITS, memo_links: int = MEMO_LINKS, part_pairs: int = PART_PAIRS) -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) per row.

    Null and empty texts, and those whose tokens do not join to a space and the
    text (as with U+2581 inside), have zeros and the empty string; they count
    for no pair. Rows that repeat, or have equal or null keys, are texts of
    their own. An empty table gives no rows. Other columns are ignored.
    `memo_units` and `memo_links` bound what a worker remembers; fewer cost
    time, not results. `part_pairs` bounds the counts that one pass broadcasts.
    """
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    counts = cut(pair_counts(docs, text, path_a, path_b, memo_units, memo_links))
    parts = _parts(counts, part_pairs)

    def scored(rows: DataFrame, low: int, high: int, whole: bool) -> DataFrame:
        part = counts.where((F.col("pair") >= low << 16) & (F.col("pair") < high << 16)).toArrow()  # about part_pairs rows
        pair, n = part.column("pair").to_numpy(), part.column("docs").to_numpy()
        order = np.argsort(pair)
        pair, n = pair[order], n[order]
        a, group = np.unique(pair >> 16, return_index=True)
        best = n == np.repeat(np.maximum.reduceat(n, group), np.diff(np.append(group, len(n)))) if len(n) else np.zeros(0, bool)
        sent = spark.sparkContext.broadcast((pair, n, best))

        def run(batches):
            memo = _aligner(path_a, path_b, memo_units, memo_links)
            pair, n, best = sent.value
            for batch in batches:
                for lo, hi, data, at in _spaced(batch, "_text"):
                    place, first = memo.places(data, at)
                    sound = _sound_rows(memo, place, first)
                    used, back = np.unique(place, return_inverse=True)
                    which, owner = _exploded(memo.first, used)
                    codes = memo.pairs[which].astype(np.int64)
                    inside = np.flatnonzero((codes >> 16 >= low) & (codes >> 16 < high))
                    found, index = np.unique(codes[inside], return_inverse=True)
                    where = np.minimum(np.searchsorted(pair, found), max(0, len(pair) - 1))
                    there = np.flatnonzero(pair[where] == found) if len(pair) else np.zeros(0, np.int64)  # texts that are not sound have pairs of no count
                    hit_n, hit_best = np.zeros(len(found), np.int64), np.zeros(len(found), np.int64)
                    hit_n[there], hit_best[there] = n[where[there]], best[where[there]]
                    unit_sum, unit_best = np.zeros(len(used), np.int64), np.zeros(len(used), np.int64)
                    np.add.at(unit_sum, owner[inside], hit_n[index])
                    np.add.at(unit_best, owner[inside], hit_best[index])
                    sums = [np.where(sound, row_sums(x[back], first), 0) for x in (unit_best, unit_sum)]
                    out = [batch.column("_row").slice(lo, hi - lo), *map(pa.array, sums)]
                    names = ["_row", "n_best", "count_sum"]
                    if whole:
                        figures = memo.figures[place]
                        out.append(batch.column("_key").slice(lo, hi - lo))
                        out += [pa.array(np.where(sound, row_sums(figures[:, i], first), 0)) for i in range(4)]
                        at_byte, _ = _exploded(memo.text_at, place)
                        shown, ends = memo.text[at_byte].tobytes(), np.concatenate([[0], np.cumsum(np.diff(memo.text_at)[place])])[first].tolist()
                        out.append(pa.array([hashlib.sha256(shown[x : y - 1]).hexdigest() if ok and y > x else "" for x, y, ok in zip(ends[:-1], ends[1:], sound.tolist())]))
                        names += ["_key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
                    yield pa.RecordBatch.from_arrays(out, names=names)

        return arrow_map(rows, run, "_row long, n_best long, count_sum long" + (f", _key {kind}, {FIGURES}" if whole else ""))

    columns = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    slim = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.monotonically_increasing_id().alias("_row"))
    if len(parts) > 1:
        slim = cut(slim)  # written once, so that a row keeps its number over the passes
    out = scored(slim, *parts[0], True)
    if len(parts) > 1:
        more = functools.reduce(DataFrame.unionByName, [scored(slim, *p, False) for p in parts[1:]])
        sums = more.groupBy("_row").agg(F.sum("n_best").alias("_best"), F.sum("count_sum").alias("_sum"))
        out = out.join(sums, "_row").withColumns({"n_best": F.col("n_best") + F.col("_best"), "count_sum": F.col("count_sum") + F.col("_sum")})
    return out.select(F.col("_key").alias(key), *(F.col(c).alias(n) for c, n in zip(columns, fresh([key], *columns))))
