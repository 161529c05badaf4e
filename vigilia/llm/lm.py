"""Language-model scoring: a unigram base and a class-factored log-bilinear model.

Word counts are taken over all training texts and stay a Spark table. The most
frequent words go to the executors in a table of fixed size; the rest of a
text's words meet their counts in a join. The log-bilinear model predicts from
the four words before: position weights times their vectors give a prediction,
whose products with class and word vectors, normalised by softmax over classes
and over the words of the class, are the token's probability. It is trained in
numpy with noise-contrastive estimation on all training texts, whose vocabulary
ids are written once, dealt over rounds: in each round every task passes over
its own share, stretch by stretch, and the tasks' parameters are averaged by the
tokens they saw. There is a round for every doubling of the corpus, so that more
tasks also meet more often. A stretch's vectors are gathered once and shifted, as
a token is context of the tokens after it. A word outside its vocabulary
has the probability of the unknown word times its share of all words outside,
so every text's probability is a proper one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilia.llm.common import arrow_map, cut, fold, fresh, shared_dir
from vigilia.llm.textbytes import SPACE, U64, HashIndex, lower_ascii, map_texts, slices, sorted_sets, word_bounds, word_hashes

ADD = 0.1  # added to every count of the base
END = U64(0x9D39247E33776D41)  # the end of a text, counted as a word
HEAD_WORDS = 1 << 17
CLASSES = 64  # classes of as many words each
DEPTH, CONTEXT = 24, 4
NOISE, BATCH, RATE = 8, 8192, 0.2
TASK_TOKENS = 500_000  # the fewest tokens for which a round gets another task
PASSES = 1  # over all training texts, at every size
STRETCH = 1 << 18  # tokens that a task gathers before it trains on them
CHUNKS = 64
UNKNOWN, LIMIT = 0, CLASSES * CLASSES


def tokens(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's words in ASCII lower case, each row's closed by END, and each row's first."""
    data = lower_ascii(data)
    starts, ends, first = word_bounds(data, at, SPACE)
    hashes = word_hashes(data, starts, ends)
    rows = len(at) - 1
    out = np.empty(len(hashes) + rows, U64)
    closing = first[1:] + np.arange(rows)
    inner = np.ones(len(out), bool)
    inner[closing] = False
    out[inner], out[closing] = hashes, END
    return out, first + np.arange(rows + 1)


def count_words(docs: DataFrame, text: str) -> DataFrame:
    """(h, c) over all rows; a null text is empty and counts its end."""

    def run(batch, data, at):
        words, count = np.unique(tokens(data, at)[0], return_counts=True)
        return {"h": pa.array(words.view(np.int64)), "c": pa.array(count)}

    return map_texts(docs.select(F.col(text).alias("text")), run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


class LogBilinear:
    """Ids: 0 any unknown word, then the known words by falling count; id // CLASSES is the class. LIMIT stands before a text's start."""

    def __init__(self, known: np.ndarray, counts: np.ndarray, unknown: float, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.lookup = HashIndex(known)
        mass = np.zeros(LIMIT)
        mass[0], mass[1 : len(known) + 1] = max(unknown, ADD), counts
        mass = np.maximum(mass, 1e-3).reshape(CLASSES, CLASSES)
        total = mass.sum(axis=1)
        small = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
        self.p = {
            "left": small(LIMIT + 1, DEPTH), "place": np.full((CONTEXT, DEPTH), 1 / CONTEXT, np.float32),
            "class": small(CLASSES, DEPTH), "word": small(LIMIT, DEPTH),
            "class_bias": np.log(total / total.sum()).astype(np.float32), "word_bias": np.log(mass / total[:, None]).ravel().astype(np.float32),
        }
        self.p["left"][LIMIT] = 0
        self.squares = {k: np.full_like(v, 1e-2) for k, v in self.p.items()}
        self.class_share, self.word_share = total / total.sum(), mass / total[:, None]

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        return self.lookup.find(hashes).astype(np.int64) + 1

    def _before(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """The ids behind CONTEXT blanks, so that place at + CONTEXT - j is j before token `at`; and, for each j, the tokens before which the row has no j-th one."""
        begins = first[:-1][first[:-1] < first[1:]]
        near = [begins]
        for j in range(1, CONTEXT):
            near.append(np.concatenate([near[-1], np.minimum(begins + j, first[1:][first[:-1] < first[1:]] - 1)]))
        return np.concatenate([np.full(CONTEXT, LIMIT, ids.dtype), ids]), [np.unique(n) for n in near]

    def _predicted(self, vectors: np.ndarray, missing: list[np.ndarray]) -> np.ndarray:
        """The prediction of each token of a stretch, from the vectors of its ids and of the CONTEXT ids before it."""
        n, place = len(vectors) - CONTEXT, self.p["place"]
        h = np.zeros((n, DEPTH), np.float32)
        for j in range(1, CONTEXT + 1):
            h += vectors[CONTEXT - j : CONTEXT - j + n] * place[j - 1]
            h[missing[j - 1]] -= vectors[CONTEXT - j + missing[j - 1]] * place[j - 1]
        return h

    def train(self, ids: np.ndarray, first: np.ndarray, rng: np.random.Generator) -> None:
        """A pass of noise-contrastive estimation of the class and of the word in its class, with AdaGrad steps on stretches of the rows.

        A class has few words, so the noise enters by its expectation over all of them instead of by drawn ones.
        """
        p = self.p
        behind, missing = self._before(ids, first)
        class_noise, word_noise = (NOISE * self.class_share).astype(np.float32), (NOISE * np.maximum(self.word_share, 1e-6)).astype(np.float32)
        log_class, log_word = np.log(class_noise), np.log(word_noise)

        def step(name: str, g: np.ndarray, rows=slice(None)) -> None:
            self.squares[name][rows] += g * g
            p[name][rows] -= RATE * g / np.sqrt(self.squares[name][rows])

        def contrast(z: np.ndarray, noise: np.ndarray, target: np.ndarray) -> np.ndarray:
            np.clip(z, -20, 20, out=z)
            np.exp(np.negative(z, out=z), out=z)
            z += 1
            np.reciprocal(z, out=z)
            at = np.arange(len(z))
            hit = z[at, target] - 1
            z *= noise
            z[at, target] += hit
            return z

        for turn in rng.permutation(-(-len(ids) // BATCH)).tolist():
            begin, end = turn * BATCH, min((turn + 1) * BATCH, len(ids))
            lack = [m[np.searchsorted(m, begin) : np.searchsorted(m, end)] - begin for m in missing]
            near, vectors = behind[begin : end + CONTEXT], p["left"][behind[begin : end + CONTEXT]]
            order = np.argsort(ids[begin:end] // CLASSES, kind="stable")
            target = ids[begin:end][order]
            kind = target // CLASSES
            h = self._predicted(vectors, lack)[order]
            g = contrast(h @ p["class"].T + (p["class_bias"] - log_class), class_noise, kind)
            back = g @ p["class"]
            class_step, class_bias_step = g.T @ h, g.sum(axis=0)
            word_step, word_bias_step = np.zeros_like(p["word"]), np.zeros_like(p["word_bias"])
            bounds = np.searchsorted(kind, np.arange(CLASSES + 1))
            for c in np.flatnonzero(np.diff(bounds)).tolist():
                a, b, words = bounds[c], bounds[c + 1], slice(c * CLASSES, (c + 1) * CLASSES)
                g = contrast(h[a:b] @ p["word"][words].T + (p["word_bias"][words] - log_word[c]), word_noise[c], target[a:b] - c * CLASSES)
                back[a:b] += g @ p["word"][words]
                word_step[words], word_bias_step[words] = g.T @ h[a:b], g.sum(axis=0)
            gone = np.empty_like(back)
            gone[order] = back
            left_step, place_step = np.zeros_like(vectors), np.empty_like(p["place"])
            for j in range(1, CONTEXT + 1):
                part, no = slice(CONTEXT - j, CONTEXT - j + len(gone)), lack[j - 1]
                left_step[part] += gone * p["place"][j - 1]
                left_step[CONTEXT - j + no] -= gone[no] * p["place"][j - 1]
                place_step[j - 1] = np.einsum("nd,nd->d", gone, vectors[part]) - np.einsum("nd,nd->d", gone[no], vectors[CONTEXT - j + no])
            turned = np.argsort(near.astype(np.uint16), kind="stable")
            heads = np.flatnonzero(np.append(True, np.diff(near[turned]) != 0))
            step("place", place_step)
            step("left", np.add.reduceat(left_step[turned], heads, axis=0), near[turned][heads])
            p["left"][LIMIT] = 0
            for name, g in (("class", class_step), ("class_bias", class_bias_step), ("word", word_step), ("word_bias", word_bias_step)):
                step(name, g)

    def state(self) -> np.ndarray:
        """All parameters and their sums of squared steps in one row."""
        return np.concatenate([v.ravel() for d in (self.p, self.squares) for v in d.values()])

    def load(self, state: np.ndarray) -> None:
        at = 0
        for d in (self.p, self.squares):
            for k, v in d.items():
                d[k] = state[at : at + v.size].reshape(v.shape).astype(np.float32)
                at += v.size

    def log10(self, ids: np.ndarray, first: np.ndarray, part: int = 16384) -> np.ndarray:
        """The normalised log10 probability of each token."""
        p, out = self.p, np.empty(len(ids))
        behind, missing = self._before(ids, first)
        heads, words = np.ascontiguousarray(p["class"].T), p["word"].reshape(CLASSES, CLASSES, DEPTH)
        bias = p["word_bias"].reshape(CLASSES, CLASSES)
        for at in range(0, len(ids), part):
            target = ids[at : at + part]
            order = np.argsort(target // CLASSES, kind="stable")
            lack = [m[np.searchsorted(m, at) : np.searchsorted(m, at + len(target))] - at for m in missing]
            h = self._predicted(p["left"][behind[at : at + len(target) + CONTEXT]], lack)[order]
            target = target[order]
            kind = target // CLASSES
            z = h @ heads
            z += p["class_bias"]
            got = z[np.arange(len(z)), kind] - np.log(np.exp(z, out=z).sum(axis=1))
            bounds = np.searchsorted(kind, np.arange(CLASSES + 1))
            for c in np.unique(kind).tolist():
                a, b = bounds[c], bounds[c + 1]
                z = h[a:b] @ words[c].T
                z += bias[c]
                got[a:b] += z[np.arange(b - a), target[a:b] - c * CLASSES] - np.log(np.exp(z, out=z).sum(axis=1))
            out[at + order] = got
        return out / np.log(10)


def _dealt(model: LogBilinear, rows: DataFrame) -> DataFrame:
    """(ids, sizes, turn): the vocabulary ids of all `rows` (text, turn) and how many each text has, written once in a folder a turn."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(model.lookup)

    def run(batches):
        for batch in batches:
            turns = batch.column("turn").to_numpy()
            for lo, hi, data, at in slices(batch, "text"):
                words, first = tokens(data, at)
                ids, sizes, mine = (shared.value.find(words) + 1).astype(np.uint16), np.diff(first), turns[lo:hi]
                held = np.unique(mine)
                yield pa.RecordBatch.from_pydict({
                    "ids": pa.array([ids[np.repeat(mine == t, sizes)].tobytes() for t in held], pa.binary()),
                    "sizes": pa.array([sizes[mine == t].astype(np.int64).tobytes() for t in held], pa.binary()), "turn": pa.array(held, pa.int32()),
                })

    schema, path = "ids binary, sizes binary, turn int", shared_dir(spark)
    arrow_map(rows, run, schema).write.partitionBy("turn").parquet(path)
    return spark.read.schema(schema).parquet(path)


def _round(model: LogBilinear, rows: DataFrame) -> int:
    """Train `model` on all `rows` (ids, sizes), each task from the same start on its own; the tokens seen."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        net, seen = shared.value, 0
        net.load(net.first_state if hasattr(net, "first_state") else net.state())  # a worker that serves several tasks starts anew
        net.first_state = net.state()
        rng = np.random.default_rng(3)
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def train() -> int:
            ids, sizes = (np.concatenate(x) for x in zip(*held))
            held.clear()
            net.train(ids, np.append(0, np.cumsum(sizes)), rng)
            return len(ids)

        for batch in batches:
            for ids, sizes in zip(batch.column("ids"), batch.column("sizes")):
                held.append((np.frombuffer(ids.as_buffer(), np.uint16).astype(np.int64), np.frombuffer(sizes.as_buffer(), np.int64)))
                if sum(len(x) for x, _ in held) >= STRETCH:
                    seen += train()
        if held:
            seen += train()
        if seen:
            parts = np.array_split(net.state(), CHUNKS)
            yield pa.RecordBatch.from_pydict({"chunk": pa.array(range(CHUNKS), pa.int32()), "seen": pa.array([seen] * CHUNKS, pa.int64()), "v": pa.array([x.tobytes() for x in parts], pa.binary())})

    def mean(batches):
        sums: dict[int, list] = {}
        for batch in batches:
            for chunk, seen, v in zip(*(batch.column(c) for c in ("chunk", "seen", "v"))):
                got = sums.setdefault(chunk.as_py(), [0, 0.0])
                got[0] += seen.as_py()
                got[1] = got[1] + np.frombuffer(v.as_py(), np.float32) * float(seen.as_py())
        if sums:
            yield pa.RecordBatch.from_pydict({"chunk": pa.array(sums, pa.int32()), "seen": pa.array([n for n, _ in sums.values()], pa.int64()), "v": pa.array([(v / n).astype(np.float32).tobytes() for n, v in sums.values()], pa.binary())})

    schema = "chunk int, seen long, v binary"
    got = sorted(arrow_map(arrow_map(rows, run, schema).repartition("chunk"), mean, schema).collect(), key=lambda r: r.chunk)  # CHUNKS rows: one model
    shared.unpersist()
    if got:
        model.load(np.concatenate([np.frombuffer(r.v, np.float32) for r in got]))
    return got[0].seen if got else 0


def _trained(model: LogBilinear, docs: DataFrame, key: str, text: str, total: int, passes: int = PASSES) -> LogBilinear:
    """The model after `passes` over every row of `docs`, which has `total` tokens; `seen_tokens` counts those trained on."""
    rounds = max(1, (total // TASK_TOKENS).bit_length())
    tasks = max(1, total // rounds // TASK_TOKENS)
    rows = docs.select(F.col(key).alias("k"), F.coalesce(text, F.lit("")).alias("text"))
    dealt = _dealt(model, rows.select("text", F.pmod(F.xxhash64("k", "text"), F.lit(rounds)).cast("int").alias("turn")))
    model.seen_tokens = 0
    for _ in range(passes):
        for turn in range(rounds):
            model.seen_tokens += _round(model, dealt.where(F.col("turn") == turn).select("ids", "sizes").coalesce(tasks))
    return model


def _least_head_count(counts: DataFrame) -> int:
    """The least count with which at most HEAD_WORDS words are as frequent, on a grid of eighths of powers of two."""
    step = F.ceil(F.log2("c") * 8)
    seen = 0
    least = 1 << 62
    for r in sorted(counts.groupBy(step.alias("s")).agg(F.count("*").alias("n"), F.min("c").alias("c")).collect(), key=lambda r: -r.s):  # 512 rows at most
        seen += r.n
        if seen > HEAD_WORDS:
            break
        least = r.c
    return least


PARTS = "row long, n_tokens long, head_known long, head_log double, inner_log double, outside long, model_log double, rare array<long>, times array<int>"


def score_texts(docs: DataFrame, key: str, text: str, trained: F.Column, keep: list[str], passes: int = PASSES) -> DataFrame:
    """`keep` with n_tokens, n_known, train_tokens, base_score and score (log10) of every row; `trained` tells the rows to learn from, `passes` how often.

    A null or empty text is its end alone; long texts are scored whole; rows that
    repeat are counted and scored each. Without any row to learn from all counts
    are 0 and the model knows no word. Other columns are ignored; of kept ones
    with a name of the result the result's take the place.
    """
    results = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
    given = [c for c in keep if c.lower() not in results]
    keep = fresh(["_text", *(x.split()[0] for x in PARTS.split(", ")), "rare_log", "rare_known", "h", "c", "n"], *given)
    spark = docs.sparkSession
    learn = docs.where(trained)
    counts = cut(count_words(learn, text))
    total, kinds = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    least = _least_head_count(counts)
    head = np.array([(r.h, r.c) for r in counts.where(F.col("c") >= least).collect()], np.int64).reshape(-1, 2)  # HEAD_WORDS at most
    head_words, head_counts = np.ascontiguousarray(head[:, 0]).view(U64), head[:, 1]
    order = np.lexsort((head_words, -head_counts))
    head_words, head_counts = head_words[order], head_counts[order]
    inner = min(LIMIT - 1, len(head_words))
    outside = float(total - head_counts[:inner].sum())
    model = _trained(LogBilinear(head_words[:inner], head_counts[:inner], outside), learn, key, text, int(total), passes)
    shared = spark.sparkContext.broadcast((model, HashIndex(head_words), np.log10(head_counts + ADD)))
    schema = "".join(f"`{k}` {docs.schema[c].dataType.simpleString()}, " for k, c in zip(keep, given))

    def run(batches):
        net, words, logs = shared.value
        row = (TaskContext.get().partitionId() << 33) if TaskContext.get() else 0
        logs = np.append(logs, 0.0)  # for words that are not in the head
        for batch in batches:
            for lo, hi, data, at in slices(batch, "_text"):
                tok, start = tokens(data, at)
                place = words.find(tok)
                ids = np.where((place >= 0) & (place < LIMIT - 1), place + 1, UNKNOWN).astype(np.int64)
                sums = lambda x: np.add.reduceat(x, start[:-1])  # noqa: E731  each row has its end at least
                rare_at = np.flatnonzero(place < 0)
                rare_first = np.searchsorted(rare_at, start)
                values, times, offsets = sorted_sets(tok[rare_at], rare_first)
                log = logs[place]
                part = batch.slice(lo, hi - lo)
                columns = [
                    pa.array(row + np.arange(hi - lo)), pa.array(np.diff(start)), pa.array(sums((place >= 0).astype(np.int64))), pa.array(sums(log)),
                    pa.array(sums(np.where(ids > 0, log, 0.0))), pa.array(sums((ids == UNKNOWN).astype(np.int64))), pa.array(sums(net.log10(ids, start))),
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values.view(np.int64))), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(times.astype(np.int32))),
                ]
                row += hi - lo
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *columns], names=[*keep, *(x.split()[0] for x in PARTS.split(", "))])

    done = cut(arrow_map(docs.select(*(F.col(c).alias(k) for k, c in zip(keep, given)), F.col(text).alias("_text")), run, f"{schema}{PARTS}"))
    rare = done.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("h"), F.col("x.times").alias("n"))
    log = F.log10(F.coalesce("c", F.lit(0)) + ADD)
    tail = counts.where(F.col("c") < least)
    met = rare.join(tail, "h", "left").groupBy("row").agg(F.sum(F.col("n") * log).alias("rare_log"), F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("rare_known"))
    whole = done.drop("rare", "times").join(met, "row", "left").na.fill({"rare_log": 0.0, "rare_known": 0})
    all_log = F.col("head_log") + F.col("rare_log")
    base = float(np.log10(total + ADD * (kinds + 1)))
    rest = float(np.log10(outside + ADD * (kinds - inner + 1)))
    return whole.select(
        *(F.col(k).alias(c) for k, c in zip(keep, given)), "n_tokens", (F.col("head_known") + F.col("rare_known")).cast("long").alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (all_log - F.col("n_tokens") * base).alias("base_score"), (F.col("model_log") + all_log - F.col("inner_log") - F.col("outside") * rest).alias("score"),
    )


def score_corpus(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, held_out, ...) as score_texts; learned from rows whose fold by key is not 0. A null key is not held out."""
    held = F.coalesce(fold(F.col(key), 10) == 0, F.lit(False))
    body = fresh([key, "held_out"], "text")[0]
    rows = docs.select(F.col(key), F.col(text).alias(body), held.alias("held_out"))
    return score_texts(rows, key, body, ~F.col("held_out"), [key, "held_out"])
