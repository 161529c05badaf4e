"""Benchmark decontamination: a BM25 inverted index of test items, searched with block-max WAND.

Test items are the indexed collection; every passage of every training
document is a query against it. A posting holds its BM25 weight as a share of
its item's full score, so a passage's score for an item is the share of the
item that it covers, and one threshold serves all items. Items stand in
blocks of a few; each term has a list of its blocks with its greatest weight in
each, and a greatest weight of all. A passage whose terms' greatest weights
together stay under the threshold has no pivot and is passed over; for the
others the lists of blocks are merged, and only blocks whose sum of maxima
reaches the threshold are scored from the postings: the bounds of block-max
WAND, applied to a batch of passages at once. No item above the threshold is
missed.

What is retrieved is verified on the whole document: the runs of words of the
item's question (all sentences but the last) and of its answer (the last) must
each be found there for the most part. An answer of few words has few runs, of
which one changed word takes most; its words are also looked for where the found
runs of the question let expect them. An item whose runs are nearly all found,
those of question and answer together, is held whatever its answer.

Document frequencies, the mean length and the width of passages are counted on
Spark over all items. The index is broadcast whole as long as it is smaller than
PART_BYTES; a larger one goes out in parts of that size with the same
statistics, each of which every document meets, so results do not depend on it.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilia.llm.common import arrow_map, cut
from vigilia.llm.textbytes import BREAK, U64, HashIndex, folded, map_texts, shingle_hashes, slices, word_bounds, word_hashes

K1, B = 1.2, 0.75
THRESHOLD = 0.5
OVERLAP = 0.5
RUN = 5
NEARLY = 0.8  # of a whole item's runs
SHORT = 2 * RUN  # answers of fewer words count by words too
BLOCK = 4
PART_BYTES = 64 << 20  # of the index that is broadcast at once
WORD_BYTES = 100  # the index takes no more for a word of an item
SEGMENT = 256  # longer items are indexed in segments of so many words

_SENTENCE = re.compile(r"(?<=[.?!])\s+|\n+")


def split_item(text: str) -> tuple[str, str]:
    """Question and answer of an item: its last sentence answers. An item of one sentence is both."""
    parts = [p for p in _SENTENCE.split(text) if p and p.strip()]
    return (" ".join(parts[:-1]), parts[-1]) if len(parts) > 1 else (text, text)


def words_of(text: str) -> np.ndarray:
    data = folded(np.frombuffer(text.encode(), np.uint8))
    starts, ends, _ = word_bounds(data, np.array([0, len(data)]), BREAK)
    return word_hashes(data, starts, ends)


def _runs(words: np.ndarray) -> tuple[int, np.ndarray]:
    k = min(RUN, len(words))
    return k, np.unique(shingle_hashes(words, np.array([0, len(words)]), k)[0]) if k else np.zeros(0, U64)


def _ranges(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers of all ranges one after another."""
    stop = np.cumsum(count)
    return np.repeat(begin - (stop - count), count) + np.arange(stop[-1] if len(stop) else 0)


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and the sum of the values of each."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[heads], np.add.reduceat(values[order], heads) if len(keys) else values


class Statistics:
    """Of all entries (items' segments of SEGMENT words): how many, their mean length, the longest one, and in how many each of `terms` stands."""

    def __init__(self, entries: int, mean: float, width: int, terms: np.ndarray, frequency: np.ndarray):
        self.entries, self.mean, self.width = entries, mean, width
        order = np.argsort(terms)
        self.terms, self.frequency = terms[order], frequency[order]

    def of(self, terms: np.ndarray) -> np.ndarray:
        return self.frequency[np.searchsorted(self.terms, terms)]


class ItemIndex:
    """Postings, block maxima and the runs to verify, for items as arrays of words (question, answer, whole). Items without words are left out."""

    def __init__(self, items: list[tuple[np.ndarray, np.ndarray, np.ndarray]], statistics: Statistics, threshold: float = THRESHOLD):
        entries, owner, self.parts, self.width = [], [], items, statistics.width
        for i, (_, _, words) in enumerate(items):
            for at in range(0, len(words), SEGMENT):
                entries.append(words[at : at + SEGMENT])
                owner.append(i)
        rows = sorted(range(len(entries)), key=lambda i: (len(entries[i]), i))  # items of like length share a block
        entries, self.owner = [entries[i] for i in rows], np.array([owner[i] for i in rows], int)
        terms, at = np.unique(np.concatenate([*entries, np.zeros(0, U64)]), return_inverse=True)
        size, n = max(1, len(entries)), len(terms)
        place, count = np.unique(at * size + np.repeat(np.arange(len(entries)), [len(e) for e in entries]), return_counts=True)
        term, entry = place // size, place % size
        length = np.array([len(e) for e in entries], float)
        frequency = statistics.of(terms)
        idf = np.log1p((statistics.entries - frequency + 0.5) / (frequency + 0.5))
        norm = K1 * (1 - B + B * length / statistics.mean)
        weight = idf[term] * count * (K1 + 1) / (count + norm[entry])
        weight /= np.bincount(entry, weight, minlength=len(entries))[entry]
        self.lookup, self.blocks = HashIndex(terms), -(-len(entries) // BLOCK)
        # Postings by term, then entry; their maxima by term, then block; and each term's maximum. The last term is an unknown one.
        self.entry, self.weight, self.first = entry, weight, np.searchsorted(term, np.arange(n + 2))
        heads = np.flatnonzero(np.append(True, np.diff(term * size + entry // BLOCK) != 0)) if len(term) else np.zeros(0, np.int64)
        self.block, self.most = entry[heads] // BLOCK, np.maximum.reduceat(weight, heads) if len(term) else weight
        self.block_first = np.searchsorted(term[heads], np.arange(n + 2))
        self.top = np.append(np.maximum.reduceat(weight, self.first[:n]) if n else weight, 0.0)
        # Common terms, the most frequent of the items as long as none has more than half the threshold from them,
        # enter a block's bound as a constant: a passage's many common words are then never looked at one by one.
        share = np.zeros(len(entries))
        self.telling = np.ones(n + 1, bool)
        self.telling[-1] = False
        for t in np.lexsort((terms, -frequency)).tolist():
            mine = slice(self.first[t], self.first[t + 1])
            share[entry[mine]] += weight[mine]
            if share[entry[mine]].max() > threshold / 2:
                share[entry[mine]] -= weight[mine]
                break
            self.telling[t] = False
        self.common = np.maximum.reduceat(share, np.arange(0, len(share), BLOCK)) if len(share) else share

    def passages(self, words: np.ndarray, first: np.ndarray, threshold: float) -> list[tuple[int, int, float]]:
        """(row, item, score) of the best passage of each row for each item that reaches the threshold.

        A passage is two neighbouring stretches as wide as the longest entry,
        so each stretch of that many words lies within one passage.
        """
        if not self.blocks or not len(words):
            return []
        term = self.lookup.find(words).astype(np.int64)
        term[term < 0] = len(self.top) - 1
        stretches = -(-np.diff(first) // self.width)
        begin = np.concatenate([[0], np.cumsum(stretches)])
        row = np.repeat(np.arange(len(stretches)), stretches)
        start = first[:-1][row] + (np.arange(begin[-1]) - begin[:-1][row]) * self.width
        at = np.flatnonzero(self.telling[term])
        own = np.searchsorted(start, at, "right") - 1
        before = own[row[own] == row[own - 1]] - 1 if len(own) else own  # a stretch is the latter half of the passage before, too
        before = before[before >= 0]
        passage = np.concatenate([own, before])
        which = np.concatenate([term[at], term[at[(own > 0) & (row[own] == row[own - 1])]]]) if len(own) else term[at]
        pairs = np.unique(passage * len(self.top) + which)
        passage, which = pairs // len(self.top), pairs % len(self.top)
        eps = 1e-9
        bound = np.bincount(passage, self.top[which], minlength=len(start))
        alive = (bound + self.common.max() >= threshold - eps)[passage]  # the others have no pivot
        passage, which = passage[alive], which[alive]
        lists = self.block_first[which + 1] - self.block_first[which]
        places = _ranges(self.block_first[which], lists)
        keys, sums = _summed(np.repeat(passage, lists) * self.blocks + self.block[places], self.most[places])
        keys = keys[sums + self.common[keys % self.blocks] >= threshold - eps]
        best: dict[tuple[int, int], float] = {}
        for p in np.unique(keys // self.blocks).tolist():
            blocks = keys[(np.searchsorted(keys, p * self.blocks)) : np.searchsorted(keys, (p + 1) * self.blocks)] % self.blocks
            here = np.unique(term[start[p] : min(int(start[p]) + 2 * self.width, int(first[row[p] + 1]))])
            places = _ranges(self.first[here], self.first[here + 1] - self.first[here])
            places = places[np.isin(self.entry[places] // BLOCK, blocks)]
            for entry, score in zip(*_summed(self.entry[places], self.weight[places])):
                if score >= threshold:
                    pair = (int(row[p]), int(self.owner[entry]))
                    best[pair] = max(best.get(pair, 0.0), float(score))
        return [(r, i, s) for (r, i), s in sorted(best.items())]

    def verify(self, words: np.ndarray, item: int) -> tuple[float, float, float]:
        """The shares of the item's question, answer and whole that a document's words have."""
        question, answer, whole = self.parts[item]
        shares = [_share(words, p) for p in (question, answer, whole)]
        if 0 < len(answer) < SHORT and shares[1] < 1:
            shares[1] = max(shares[1], _near(words, question, answer))
        return tuple(shares)


def _share(words: np.ndarray, part: np.ndarray) -> float:
    k, runs = _runs(part)
    return float(np.isin(runs, shingle_hashes(words, np.array([0, len(words)]), k)[0]).mean()) if k else 1.0


def _near(words: np.ndarray, question: np.ndarray, answer: np.ndarray) -> float:
    """The greatest share of the answer's words within RUN words of where a run of the question lets expect the answer."""
    k = min(RUN, len(question))
    if not k or len(words) < k:
        return 0.0
    ours = shingle_hashes(question, np.array([0, len(question)]), k)[0]
    theirs = shingle_hashes(words, np.array([0, len(words)]), k)[0]
    order = np.argsort(ours, kind="stable")
    at = np.searchsorted(ours[order], theirs).clip(0, len(ours) - 1)
    place = np.flatnonzero(ours[order][at] == theirs)
    wanted = np.unique(answer)
    starts = np.unique(place - order[at[place]] + len(question)).tolist()
    return max((float(np.isin(wanted, words[max(0, e - RUN) : max(0, e + len(answer) + RUN)]).mean()) for e in starts), default=0.0)


def item_words(items: DataFrame, key: str, text: str) -> DataFrame:
    """(item, question, answer, whole): the words of each item that has any, as hashes. Written once."""
    kind = items.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows, columns = [], ([], [], [])
            for row, text in enumerate(batch.column(1).to_pylist()):
                whole = words_of(text or "")
                if len(whole):
                    rows.append(row)
                    for column, words in zip(columns, (*(words_of(p) for p in split_item(text)), whole)):
                        column.append(words.view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(c, pa.list_(pa.int64())) for c in columns)], names=["item", "question", "answer", "whole"])

    return cut(arrow_map(items.select(F.col(key).alias("item"), F.col(text).alias("text")), run, f"item {kind}, question array<long>, answer array<long>, whole array<long>"))


def indexes(items: DataFrame, key: str, text: str, threshold: float = THRESHOLD) -> list:
    """(index, keys of its items as an Arrow array) for as many parts as the items need; the driver holds one part at a time."""
    spark, words = items.sparkSession, item_words(items, key, text)
    size = F.size("whole")
    total, width, entries = words.agg(F.coalesce(F.sum(size), F.lit(0)), F.least(F.coalesce(F.max(size), F.lit(1)), F.lit(SEGMENT)), F.coalesce(F.sum(F.ceil(size / SEGMENT)), F.lit(0))).first()
    segments = F.transform(F.sequence(F.lit(0), F.expr(f"int((size(whole) - 1) div {SEGMENT})")), lambda i: F.slice("whole", i * SEGMENT + 1, SEGMENT))
    frequency = cut(words.select(F.explode(segments).alias("s")).select(F.explode(F.array_distinct("s")).alias("term")).groupBy("term").agg(F.count("*").alias("n")))
    parts = max(1, -(-int(total) * WORD_BYTES // PART_BYTES))
    part = F.pmod(F.xxhash64("whole", "item"), F.lit(parts)).cast("int")
    out = []
    for k in range(parts):
        mine = words.where(part == k)
        terms = frequency if parts == 1 else frequency.join(mine.select(F.explode("whole").alias("term")).distinct(), "term", "left_semi")
        known, rows = terms.toArrow(), mine.orderBy(F.xxhash64("whole"), "item").toArrow()  # PART_BYTES at most, but for what one item has over it
        arrays = [rows.column(c).combine_chunks() for c in ("question", "answer", "whole")]
        lists = [[a.values[i:j].to_numpy().view(U64) for i, j in zip(o[:-1], o[1:])] for a in arrays for o in [a.offsets.to_pylist()]]
        statistics = Statistics(int(entries), total / max(1, entries), width, known.column("term").to_numpy().view(U64), known.column("n").to_numpy())
        keys = rows.column("item").combine_chunks()
        out.append(spark.sparkContext.broadcast((ItemIndex(list(zip(*lists)), statistics, threshold), keys)))
    return out


def _found(index: ItemIndex, data: np.ndarray, at: np.ndarray, threshold: float, overlap: float):
    """(row, item, score, question share, answer share) of each item that a row of texts holds."""
    data = folded(data)
    starts, ends, first = word_bounds(data, at, BREAK)
    words = word_hashes(data, starts, ends)
    for row, item, score in index.passages(words, first, threshold):
        question, answer, whole = index.verify(words[first[row] : first[row + 1]], item)
        if (question >= overlap and answer >= overlap) or whole >= max(NEARLY, overlap):
            yield row, item, round(score, 6), question, answer


def contaminated(docs: DataFrame, items: DataFrame, key: str, text: str, item_key: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """(key, item_id, score, question_overlap, answer_overlap): documents that hold a test item, with each item they hold.

    Keys may be of any type and null. Null and empty texts on either side match
    nothing; items with equal texts are all reported, one that is listed twice
    twice; rows that repeat a document are reported as often. Long texts are
    searched whole. Either table may be empty. Other columns are ignored.
    """
    kinds = docs.schema[key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    schema = f"_k {kinds[0]}, _i {kinds[1]}, score double, question_overlap double, answer_overlap double"
    out = None
    for shared in indexes(items, item_key, item_text, threshold):
        found = map_texts(docs.select(F.col(key).alias("_k"), F.col(text).alias("_t")), _report(shared, threshold, overlap), schema, "_t")
        out = found if out is None else out.unionByName(found)
    return out.select(F.col("_k").alias(key), F.col("_i").alias(item_key), "score", "question_overlap", "answer_overlap")


def _report(shared, threshold: float, overlap: float):
    def run(batch, data, at):
        index, keys = shared.value
        if found := list(_found(index, data, at, threshold, overlap)):
            rows, items, score, question, answer = zip(*found)
            return {"_k": batch.column(0).take(pa.array(rows)), "_i": keys.take(pa.array(items)), "score": pa.array(score), "question_overlap": pa.array(question), "answer_overlap": pa.array(answer)}
        return None

    return run


def drop_contaminated(docs: DataFrame, items: DataFrame, text: str, item_key: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """The rows of `docs` that hold no test item, whole and judged one by one: keys and other columns, whatever their names, do not matter."""
    at_column = docs.columns.index(text)
    for shared in indexes(items, item_key, item_text, threshold):
        docs = arrow_map(docs, _clean(shared, at_column, threshold, overlap), docs.schema)
    return docs


def _clean(shared, column: int, threshold: float, overlap: float):
    def run(batches):
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for lo, _, data, at in slices(batch, column):
                keep[[lo + row for row, *_ in _found(shared.value[0], data, at, threshold, overlap)]] = False
            yield batch.filter(pa.array(keep))

    return run
