"""Language identification by a byte convolutional network written in numpy.

A text is cut into windows of a fixed number of bytes. Bytes are embedded,
filters of several widths slide over them, each filter's greatest response in
a window is rectified, and a softmax layer names the language. A text's
distribution is that of the mean logits of all its windows, so the whole text
counts. Training is plain Adam on windows of a bounded sample of texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilia.llm.common import arrow_map, fold, fresh, one_a_key
from vigilia.llm.textbytes import slices, text_buffers

WINDOW = 96
EMBED = 6
WIDTHS, FILTERS = (2, 3, 4), 12  # the widest spans two pairs of bytes
TRAIN_TEXTS = 3000
TRAIN_WINDOWS = 6
EPOCHS, BATCH, RATE = 5, 128, 0.01
UNDETERMINED = "und"

#: Byte classes: letters keep their own row, in lower case; digits, blanks and other ASCII signs share one each.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[i for i in range(128) if not chr(i).isalpha()]] = 1
_FOLD[[i for i in range(128) if chr(i).isspace()]] = 2
_FOLD[0] = 0
CODES = len(np.unique(_FOLD))


class ByteCNN:
    """Embedding (256, EMBED), one matrix of all filters over the widest window (narrow filters are zero beyond theirs), and a softmax layer."""

    def __init__(self, classes: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.classes, self.ready = classes, None
        wide, count = max(WIDTHS), FILTERS * len(WIDTHS)
        self.mask = np.zeros((wide, EMBED, count), np.float32)
        for i, w in enumerate(WIDTHS):
            self.mask[:w, :, i * FILTERS : (i + 1) * FILTERS] = 1
        self.mask = self.mask.reshape(wide * EMBED, count)
        self.p = {
            "embed": rng.normal(0, 0.5, (256, EMBED)).astype(np.float32),
            "filters": (rng.normal(0, 0.3, (wide * EMBED, count)) * self.mask).astype(np.float32),
            "bias": np.zeros(count, np.float32),
            "out": rng.normal(0, 0.1, (count, len(classes))).astype(np.float32),
            "out_bias": np.zeros(len(classes), np.float32),
        }

    def _unfold(self, windows: np.ndarray) -> np.ndarray:
        wide = max(WIDTHS)
        rows = self.p["embed"][windows]
        return np.concatenate([rows[:, j : WINDOW - wide + 1 + j] for j in range(wide)], axis=2)

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The codes of bytes and, for each pair of codes, the filters' responses to it as first and as last half of the widest window.

        A filter's response is a sum over the bytes it covers, so two look-ups
        and an addition replace the product of a window with the filters.
        """
        if self.ready is None:
            used = np.unique(_FOLD)
            code = np.zeros(256, np.int32)
            code[used] = np.arange(len(used))
            parts = [self.p["embed"][used] @ self.p["filters"][j * EMBED : (j + 1) * EMBED] for j in range(max(WIDTHS))]
            pair = lambda i: (parts[i][:, None] + parts[i + 1][None]).reshape(len(used) ** 2, -1)
            self.ready = code, pair(0), pair(2)
        return self.ready

    def pooled(self, windows: np.ndarray) -> np.ndarray:
        code, head, tail = self.tables()
        codes = code[windows]
        pairs = codes[:, :-1] * CODES + codes[:, 1:]
        raw = head[pairs[:, : WINDOW - 3]]
        raw += tail[pairs[:, 2:]]
        while raw.shape[1] > 1:  # halving keeps the inner loops long
            half = raw.shape[1] // 2
            top = np.maximum(raw[:, :half], raw[:, half : 2 * half])
            raw = top if raw.shape[1] % 2 == 0 else np.concatenate([top, raw[:, -1:]], axis=1)
        return np.maximum(raw[:, 0] + self.p["bias"], 0)

    def logits(self, windows: np.ndarray) -> np.ndarray:
        """(windows, classes), a hundred windows at a time so that the responses stay in the cache."""
        out = [self.pooled(windows[i : i + 100]) @ self.p["out"] + self.p["out_bias"] for i in range(0, len(windows), 100)]
        return np.concatenate(out) if out else np.zeros((0, len(self.classes)), np.float32)

    def gradients(self, windows: np.ndarray, target: np.ndarray) -> dict[str, np.ndarray]:
        n, rows = len(windows), np.arange(len(windows))
        flat = self._unfold(windows)
        raw = (flat.reshape(-1, flat.shape[2]) @ self.p["filters"]).reshape(n, -1, len(self.p["bias"]))
        place = raw.argmax(axis=1)
        top = np.take_along_axis(raw, place[:, None], 1)[:, 0] + self.p["bias"]
        hidden = np.maximum(top, 0)
        z = hidden @ self.p["out"] + self.p["out_bias"]
        prob = np.exp(z - z.max(axis=1, keepdims=True))
        prob /= prob.sum(axis=1, keepdims=True)
        prob[rows, target] -= 1
        prob /= n
        back = (prob @ self.p["out"].T) * (top > 0)
        picked = flat[rows[:, None], place]  # (n, filters, wide * EMBED): what each filter saw at its greatest response
        filters = np.einsum("nf,nfk->kf", back, picked) * self.mask
        seen = back[:, :, None] * self.p["filters"].T[None]
        embed = np.zeros_like(self.p["embed"])
        for j in range(max(WIDTHS)):
            np.add.at(embed, windows[rows[:, None], place + j], seen[:, :, j * EMBED : (j + 1) * EMBED])
        return {"embed": embed, "filters": filters, "bias": back.sum(axis=0), "out": hidden.T @ prob, "out_bias": prob.sum(axis=0)}

    def train(self, windows: np.ndarray, target: np.ndarray, epochs: int = EPOCHS, seed: int = 11) -> None:
        self.ready = None
        rng = np.random.default_rng(seed)
        first, second = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        turn, total = 0, epochs * -(-len(windows) // BATCH)
        for _ in range(epochs):
            order = rng.permutation(len(windows))
            for at in range(0, len(order), BATCH):
                rows = order[at : at + BATCH]
                turn += 1
                rate = RATE * (1 - turn / (total + 1)) * np.sqrt(1 - 0.999**turn) / (1 - 0.9**turn)
                for k, g in self.gradients(windows[rows], target[rows]).items():
                    first[k] += 0.1 * (g - first[k])
                    second[k] += 0.001 * (g * g - second[k])
                    self.p[k] -= (rate * first[k] / (np.sqrt(second[k]) + 1e-8)).astype(np.float32)


def windows_of(data: np.ndarray, at: np.ndarray, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Windows of all rows, zero beyond a text's end, and each row's first; `most` evenly spread ones where it is given (training)."""
    sizes = np.diff(at)
    step = WINDOW - max(WIDTHS) + 1  # the filters meet each position once
    counts = np.where(sizes > 0, np.maximum(1, -(-(sizes - max(WIDTHS) + 1) // step)), 0)
    taken = counts if most is None else np.minimum(counts, most)
    first = np.concatenate([[0], np.cumsum(taken)])
    row = np.repeat(np.arange(len(sizes)), taken)
    k = np.arange(first[-1]) - first[:-1][row]
    k = k * counts[row] // np.maximum(taken[row], 1)
    place = at[:-1][row] + k * step
    grid = place[:, None] + np.arange(WINDOW)
    padded = np.concatenate([data, np.zeros(WINDOW + 1, np.uint8)])
    return np.where(grid < at[1:][row][:, None], _FOLD[padded[np.minimum(grid, len(data))]], 0), first


def fit_language(docs: DataFrame, key: str, text: str, label: str, bound: int = TRAIN_TEXTS) -> ByteCNN | None:
    """Train on at most `bound` texts with a label, those whose keys hash lowest; None if there are none.

    Rows without a key, a text or a label are passed over; of rows that share a
    key one counts. Keys may be of any type.

    The rarest label is not lost: the texts are dealt by label in turn, so each
    label has about an equal part of the bound as far as its texts go.
    """
    from pyspark.sql import Window as W

    rows = docs.where(F.col(label).isNotNull() & F.col(text).isNotNull() & F.col(key).isNotNull() & (F.col(text) != ""))
    slim = rows.select(F.col(key).alias("k"), F.col(label).alias("l"), F.xxhash64(key).alias("h"))
    sizes = {r.l: r["count"] for r in slim.groupBy("l").count().collect()}  # a row a language
    share = {name: min(1.0, 2 * bound / n) for name, n in sizes.items()}
    most = F.create_map(*(x for name, s in share.items() for x in (F.lit(name), F.lit(min(int(s * 2**64) - 2**63, 2**63 - 1)).cast("long"))))
    few = slim.where(F.col("h") <= F.try_element_at(most, F.col("l"))) if sizes else slim  # about twice the bound a language
    turn = few.withColumn("r", F.row_number().over(W.partitionBy("l").orderBy("h", "k"))).where(F.col("r") <= bound)
    chosen = turn.orderBy("r", "h").limit(bound).select("k").distinct()
    sample = rows.select(F.col(key).alias("k"), F.col(text).alias("text"), F.col(label).alias("label")).join(F.broadcast(chosen), "k", "left_semi")
    sample = one_a_key(sample, "k", "text", "label").select("text", "label")  # `bound` rows at most

    def cut_windows(batches):
        for batch in batches:
            for lo, hi, data, at in slices(batch, "text"):
                grid, first = windows_of(data, at, TRAIN_WINDOWS)
                labels = batch.column(1).slice(lo, hi - lo).take(pa.array(np.repeat(np.arange(hi - lo), np.diff(first))))
                yield pa.RecordBatch.from_arrays([pa.array([w.tobytes() for w in grid.astype(np.uint8)], pa.binary()), labels], names=["window", "label"])

    got = arrow_map(sample, cut_windows, "window binary, label string").collect()  # TRAIN_WINDOWS of each text at most
    if not got:
        return None
    got.sort(key=lambda r: (r.label, bytes(r.window)))
    classes = sorted({r.label for r in got})
    model = ByteCNN(classes)
    grid = np.frombuffer(b"".join(bytes(r.window) for r in got), np.uint8).reshape(-1, WINDOW).astype(np.int64)
    model.train(grid, np.array([classes.index(r.label) for r in got]))
    return model


def predict(docs: DataFrame, model: ByteCNN | None, text: str, keep: list[str], names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns `keep` with lang_pred and score, or as `names` says, for every row.

    A text that is null or has no letter is `und` with score 1, as is every
    text if nothing could be learned; equal logits go to the first label. Each
    row stands for itself, also one that repeats. Other columns are ignored; of
    kept ones with one of the two names the result's take the place.
    """
    keep = [c for c in keep if c.lower() not in [n.lower() for n in names]]
    schema = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        net = shared.value
        for batch in batches:
            for lo, hi, data, at in slices(batch, len(keep)):
                found, scores = _name(net, data, at)
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns[:-1], pa.array(found, pa.string()), pa.array(scores, pa.float64())], names=[*keep, *names])

    return arrow_map(docs.select(*keep, F.col(text).alias(*fresh(keep, "_text"))), run, f"{schema}`{names[0]}` string, `{names[1]}` double")


def _letters(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether each row has a letter: an ASCII one is seen in the bytes, for others the text is read."""
    ascii_letter = ((data >= 65) & (data <= 90)) | ((data >= 97) & (data <= 122))
    sums = np.concatenate([[0], np.cumsum(ascii_letter)])
    out = sums[at[1:]] > sums[at[:-1]]
    for row in np.flatnonzero(~out & (at[1:] > at[:-1])).tolist():
        out[row] = any(map(str.isalpha, data[at[row] : at[row + 1]].tobytes().decode("utf-8", "replace")))
    return out


def _name(net: ByteCNN | None, data: np.ndarray, at: np.ndarray) -> tuple[list[str], np.ndarray]:
    some = _letters(data, at) if net else np.zeros(len(at) - 1, bool)
    names, scores = np.full(len(at) - 1, UNDETERMINED, object), np.ones(len(at) - 1)
    if some.any():
        grid, first = windows_of(data, at)
        z = np.concatenate([np.zeros((1, len(net.classes))), np.cumsum(net.logits(grid), axis=0, dtype=np.float64)])
        mean = (z[first[1:]] - z[first[:-1]]) / np.maximum(np.diff(first), 1)[:, None]
        prob = np.exp(mean - mean.max(axis=1, keepdims=True))
        prob /= prob.sum(axis=1, keepdims=True)
        best = prob.argmax(axis=1)
        names[some] = np.array(net.classes, object)[best[some]]
        scores[some] = np.clip(prob[np.arange(len(best)), best][some], 0, 1)
    return names.tolist(), scores


def identify(docs: DataFrame, key: str, text: str, label: str) -> DataFrame:
    """(key, held_out, lang_pred, score); learned from the rows whose fold by key is not 1. As fit_language and predict for odd rows; a null key is not held out."""
    held = F.coalesce(fold(F.col(key), 3) == 1, F.lit(False))
    model = fit_language(docs.where(~held), key, text, label)
    return predict(docs.select(F.col(key), held.alias("held_out"), F.col(text).alias("_text")), model, "_text", [key, "held_out"])
