"""Toxicity by two class-conditional Kneser-Ney models.

One model is counted on toxic and one on ordinary labelled texts. Both back
off from discounted bigrams (order 2) or at once (order 1) to their own
continuation counts, and from those to continuation counts shared by both classes, so an expression that a class has
seldom seen is judged by what the two have together, and a word that neither
knows says nothing. A text's evidence is the mean over its words of the
difference of log-likelihoods; a logistic curve, fitted to the evidence that
models of one half give the other half, turns it into a score. The order and
the doubt (below) are those that foretell the other half best.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilia.llm.common import arrow_map, cut, fold, fresh, lowest, one_a_key, train_in_task
from vigilia.llm.textbytes import BREAK, U64, HashIndex, folded, mix, row_sums, slices, sorted_sets, word_bounds, word_hashes

DISCOUNT = 0.75
#: By how many of its standard errors a word's or bigram's log-ratio is drawn towards nothing, and orders, to choose from.
#: Most of a text is words that a small class has seen a few times: without this their chance ratios drown the telling ones.
DOUBTS = (1.0, 1.5, 2.0, 2.5)
ORDERS = (1, 2)
MARGIN = 0.7  # and by a factor of two, so that what toxic texts are about, or their language, is no evidence
FLOOR = 0.02  # the most that one ordinary word counts against a text, so that a long quiet stretch hides nothing
TRAIN_TEXTS = 6000
TRAIN_WORDS = 12_000_000  # of the sampled texts together; a sample with more ends there
LEAST = 2  # words and bigrams seen less often in all are left to the shared counts


def token_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-case words without punctuation, and each row's first."""
    data = folded(data)
    starts, ends, first = word_bounds(data, at, BREAK)
    return word_hashes(data, starts, ends), first


def _before(ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The id before each word; 0, that of a text's start, for the first of a row."""
    out = np.zeros(len(ids), np.int64)
    out[1:] = ids[:-1]
    out[first[:-1][first[:-1] < first[1:]]] = 0
    return out


class Vocabulary:
    """Ids of words: 0 a text's start, 1 any unknown word, then the words seen at least LEAST times."""

    def __init__(self, words: np.ndarray):
        terms, seen = np.unique(words, return_counts=True)
        self.known = terms[seen >= LEAST]
        self.lookup, self.size = HashIndex(self.known), len(self.known) + 2

    def ids(self, words: np.ndarray) -> np.ndarray:
        return np.maximum(self.lookup.find(words) + 2, 1).astype(np.int32)


class Counts:
    """What both classes' texts are counted for."""

    def __init__(self, ids: np.ndarray, first: np.ndarray, toxic: np.ndarray, size: int):
        side = np.repeat(toxic, np.diff(first))
        pair, self.count = np.unique((_before(ids, first) * size + ids) * 2 + side, return_counts=True)
        self.size, self.side, self.pair = size, (pair % 2).astype(np.int8), pair // 2
        right = self.pair % size
        #: Distinct left neighbours of each word, in each class and in both together.
        self.types = np.stack([np.bincount(right[self.side == c], minlength=size) for c in (0, 1)]).astype(float)
        self.shared = np.bincount(np.unique(self.pair) % size, minlength=size).astype(float)


def _doubted(ratio: np.ndarray, counts: np.ndarray, doubt: float) -> np.ndarray:
    error = np.sqrt((1 / np.maximum(counts, 0.5)).sum(axis=0))
    return np.maximum(np.sign(ratio) * np.maximum(np.abs(ratio) - doubt * error - MARGIN, 0), -FLOOR)


class Likelihoods:
    """Log-ratios of the Kneser-Ney models of both classes, of words (order 1) or of bigrams (order 2)."""

    def __init__(self, counts: Counts, doubt: float, order: int):
        size, total = counts.size, max(1.0, counts.shared.sum())
        self.size, self.order = size, order
        kept = np.maximum(counts.shared - DISCOUNT, 0)
        base = kept / total + (1 - kept.sum() / total) / size
        word, back = np.empty((2, size)), np.ones((2, size))
        for c in (0, 1):
            n = max(1.0, counts.types[c].sum())
            kept = np.maximum(counts.types[c] - DISCOUNT, 0)
            word[c] = kept / n + (1 - kept.sum() / n) * base
        self.words = _doubted(np.log(word[1] / word[0]), counts.types, doubt)
        self.words[:2] = 0.0  # a word that neither class knows
        if order == 1:
            return
        both, where = np.unique(counts.pair, return_inverse=True)
        seen = np.zeros((2, len(both)))
        seen[counts.side, where] = counts.count
        v, w = both // size, both % size
        like = np.empty((2, len(both)))
        for c in (0, 1):
            times = np.bincount(v, seen[c], minlength=size)
            taken = np.bincount(v, np.minimum(seen[c], DISCOUNT), minlength=size)
            back[c][times > 0] = taken[times > 0] / times[times > 0]
            like[c] = np.maximum(seen[c] - DISCOUNT, 0) / np.maximum(times[v], 1) + back[c][v] * word[c][w]
        often = (seen.sum(axis=0) >= LEAST) & (v > 1) & (w > 1)  # others back off to their word
        self.pairs = HashIndex(mix(both[often].astype(U64) + U64(1)))
        self.bigrams = _doubted(np.log(like[1] / like[0])[often], seen[:, often], doubt).astype(np.float32)

    def evidence(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The mean difference of log-likelihoods over the distinct bigrams of each row, 0 for a row without words."""
        pairs, _, first = sorted_sets(_before(ids, first) * self.size + ids, first)  # what a text repeats counts once
        out = self.words[pairs % self.size]
        if self.order == 2:
            at = self.pairs.find(mix(pairs.astype(U64) + U64(1)))
            hit = at >= 0
            out[hit] = self.bigrams[at[hit]]
        return row_sums(out, first) / np.maximum(np.diff(first), 1)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope (never negative) and intercept by damped Newton steps with a slight penalty."""
    scale = float(np.std(x)) or 1.0
    z = x / scale
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(w[0] * z + w[1], -30, 30)))
        g = np.array([(weight * (p - y) * z).sum() + 0.1 * w[0], (weight * (p - y)).sum()])
        r = weight * (p * (1 - p) + 1e-6)
        h = np.array([[(r * z * z).sum() + 0.1, (r * z).sum()], [(r * z).sum(), r.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        w -= step * min(1.0, 5.0 / max(1e-9, float(np.abs(step).max())))
    return max(0.0, float(w[0])) / scale, float(w[1])


class ToxicityModel:
    def __init__(self, texts: list[np.ndarray], toxic: np.ndarray, shares: tuple[float, float] | None = None):
        """`shares`: how many labelled texts of each class a sampled one stands for (ordinary, toxic)."""
        weight = np.where(toxic, *((shares or (1.0, 1.0))[::-1]))
        self.rate = float((weight * toxic).sum() / weight.sum()) if len(toxic) else 0.0
        self.model, self.slope, self.intercept = None, 0.0, 0.0
        if not 0 < toxic.sum() < len(toxic):
            return
        half = np.zeros(len(texts), int)
        for c in (False, True):  # each half gets its share of both classes
            half[toxic == c] = np.arange(int((toxic == c).sum())) % 2
        words, first = _joined(texts)
        self.words = Vocabulary(words)
        ids = self.words.ids(words)
        del words
        halves = []
        for h in (0, 1):
            mine, other = half == h, np.flatnonzero(half != h)
            halves.append((Counts(*_rows(ids, first, np.flatnonzero(mine)), toxic[mine], self.words.size), other, _rows(ids, first, other)))
        best = np.inf
        for order in ORDERS:
            for doubt in DOUBTS:
                x = np.zeros(len(texts))
                for counts, other, rows in halves:
                    x[other] = Likelihoods(counts, doubt, order).evidence(*rows)
                slope, intercept = _logistic(x, toxic.astype(float), weight)
                p = np.clip(1 / (1 + np.exp(-np.clip(slope * x + intercept, -30, 30))), 1e-6, 1 - 1e-6)
                loss = -(weight * np.where(toxic, np.log(p), np.log(1 - p))).mean()
                if loss < best:
                    best, self.slope, self.intercept, chosen = loss, slope, intercept, (doubt, order)
        self.chosen = chosen
        self.model = Likelihoods(Counts(ids, first, toxic, self.words.size), *chosen)

    def score(self, words: np.ndarray, first: np.ndarray) -> np.ndarray:
        if self.model is None:
            return np.full(len(first) - 1, self.rate)
        return 1 / (1 + np.exp(-np.clip(self.slope * self.model.evidence(self.words.ids(words), first) + self.intercept, -30, 30)))


def _joined(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([*texts, np.zeros(0, U64)]), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def _rows(ids: np.ndarray, first: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.diff(first)[rows]
    return np.concatenate([*(ids[first[r] : first[r + 1]] for r in rows.tolist()), ids[:0]]), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def fit_toxicity(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, bound: int = TRAIN_TEXTS, most_words: int = TRAIN_WORDS) -> ToxicityModel:
    """Learn from at most `bound` labelled texts, up to a quarter of them toxic, those of each class whose keys hash lowest.

    Rows without a key, a label or a text are passed over; of several labels of
    one key the greatest counts, of several texts one. The texts are taken whole,
    in the order of their keys' hashes, as long as they have no more than
    `most_words` words together. Keys may be of any type both tables share.
    """
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.max(F.col(label)).alias("_label"))
    known = cut(known)
    sizes = {r.t: r["count"] for r in known.groupBy((F.col("_label") > 0).alias("t")).count().collect()}
    toxic = min(bound // 4, sizes.get(True, 0))
    ordinary = min(bound - toxic, sizes.get(False, 0))
    shares = sizes.get(False, 0) / max(1, ordinary), sizes.get(True, 0) / max(1, toxic)
    chosen = lowest(known.where("_label > 0"), "_key", toxic).unionByName(lowest(known.where("_label <= 0"), "_key", ordinary))
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).where("_text IS NOT NULL").join(F.broadcast(chosen), "_key")  # `bound` rows at most
    rows = one_a_key(rows, "_key", "_text", "_label").select(F.xxhash64("_key").alias("_h"), F.col("_key").cast("string").alias("_key"), "_text", (F.col("_label") > 0).alias("_toxic"))

    def run(batches):
        for batch in batches:
            for lo, hi, data, at in slices(batch, "_text"):
                words, first = token_hashes(data, at)
                packed = [words[a:b].tobytes() for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([part.column("_h"), part.column("_key"), part.column("_toxic"), pa.array(packed, pa.binary())], names=["h", "key", "toxic", "words"])

    def train(batches) -> ToxicityModel:
        texts, toxic, total = [], [], 0
        for batch in batches:
            for y, w in zip(batch.column(2).to_pylist(), batch.column(3)):
                words = np.frombuffer(w.as_buffer(), U64)
                if total + len(words) <= most_words:
                    total += len(words)
                    texts.append(words.copy())
                    toxic.append(y)
        return ToxicityModel(texts, np.array(toxic, bool), shares)

    return train_in_task(arrow_map(rows, run, "h long, key string, toxic boolean, words binary"), ["h", "key"], train)


def score_texts(docs: DataFrame, model: ToxicityModel, text: str, keep: list[str], names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """The columns `keep` with score and predicted, or as `names` says, for every row; null and empty texts have no evidence either way.

    Each row stands for itself, also one that repeats. Other columns are ignored;
    of kept ones with one of the two names the result's take the place.
    """
    keep = [c for c in keep if c.lower() not in [n.lower() for n in names]]
    schema = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for lo, hi, data, at in slices(batch, len(keep)):
                score = shared.value.score(*token_hashes(data, at))
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns[:-1], pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=[*keep, *names])

    return arrow_map(docs.select(*keep, F.col(text).alias(*fresh(keep, "_text"))), run, f"{schema}`{names[0]}` double, `{names[1]}` int")


def toxicity(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str) -> DataFrame:
    """(key, held_out, score, predicted); learned from labelled rows whose fold by key is not 0. As fit_toxicity and score_texts for odd rows; a null key is not held out."""
    held = F.coalesce(fold(F.col(key), 5) == 0, F.lit(False))
    model = fit_toxicity(docs, labels.where(~held), key, text, label)
    rows = docs.select(F.col(key), held.alias("held_out"), F.col(text).alias("_text"))
    return score_texts(rows, model, "_text", [key, "held_out"])
