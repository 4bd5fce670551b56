"""Operator 2: language-model scoring with a log-bilinear model.

Word counts of the whole training part are Spark's. The ``targets`` most frequent words are predicted as
themselves, all others as one of 512 classes by their last letters, inside which a word has its
discounted share; what is discounted is the probability of an unknown word of the class. The context
of a token is the two tokens before it; there, the ``own`` most frequent words have vectors of their own
and the others share those of 512 classes.

The model is trained in numpy with noise-contrastive estimation: a warm start on a bounded sample of
documents, then every task goes once over its own training texts and Spark averages what the tasks
made of each vector, weighted by how often they met it. Scores are normalised: the model is bilinear,
so the normalisers of all pairs of context classes are one matrix product,

    Z[a, b] = sum_w exp(left[a, w]) exp(right[b, w]),

computed once as a Spark job over blocks of rows, a table of fixed size. A token's log-probability is
then a product of two vectors and a look-up.

The ``frequent`` most frequent words travel to the workers with their counts (a bounded table). The
counts of all other words are met by a join on the word; no word among them is frequent enough to
overload a task.

Null texts count as empty: only the end token is scored. A null document id is training data.
Repeated rows are scored row by row. An empty table gives an empty result; without training
documents every token is unknown.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haltbook.llm.common import Generations, stored

END = b""
SHARED = 512


def class_of(word: str) -> int:
    return zlib.crc32(word[-3:].encode()) % SHARED


@dataclass
class Words:
    """What the workers know about words: place, class and count of the frequent ones."""

    place: dict[bytes, int]
    kind: np.ndarray
    count: np.ndarray
    own: int
    targets: int
    total: int
    types: int
    discount: float
    class_tokens: np.ndarray
    class_types: np.ndarray

    def shared(self, word: bytes) -> int:
        return self.targets + class_of(word.decode())

    def contexts(self) -> np.ndarray:
        """The context class of each target."""
        out = np.concatenate([np.arange(self.targets), self.own + np.arange(SHARED)])
        for word, i in self.place.items():
            if self.own <= i < self.targets:
                out[i] = self.own + class_of(word.decode())
        return out

    def base(self, count):
        return np.log10((count + 0.5) / (self.total + 0.5 * (self.types + 1)))

    def inside(self) -> np.ndarray:
        """log10 of each frequent word's probability in its class."""
        if not len(self.kind):
            return np.zeros(0)
        return np.where(self.kind < self.targets, 0.0, np.log10((self.count - self.discount) / np.maximum(self.class_tokens[self.kind], 1e-9)))

    def places(self, tokens: list[bytes]) -> np.ndarray:
        """Place of each token, -1 for words that are not frequent."""
        return np.array(list(map(self.place.get, tokens, repeat(-1))), np.int64)

    def kinds(self, tokens: list[bytes], places: np.ndarray, known: Generations) -> np.ndarray:
        """Targets of the tokens, after the two ends that begin every text."""
        end = self.place.get(END)
        first = self.kind[end] if end is not None else self.shared(END)
        out = np.empty(len(tokens) + 2, np.int64)
        out[:2] = first
        out[2:] = self.kind[places] if len(self.kind) else 0
        for i in np.flatnonzero(places < 0).tolist():
            t = tokens[i]
            k = known.young.get(t)
            if k is None:
                k = known.young[t] = self.shared(t)
            out[i + 2] = k
        known.turn()
        return out


def tokens_of(text: bytes | None) -> list[bytes]:
    return [*(text or b"").lower().split(), END]


@dataclass
class Bilinear:
    """Parameters: class vectors as context and as target, a matrix for each context place, bias."""

    context: np.ndarray
    target: np.ndarray
    places: np.ndarray
    bias: np.ndarray

    @classmethod
    def start(cls, share: np.ndarray, contexts: int, size: int) -> Bilinear:
        rng = np.random.default_rng(0)
        context, target = (rng.normal(0, 0.1, (n, size)).astype("f4") for n in (contexts, len(share)))
        eye = np.stack([np.eye(size, dtype="f4")] * 2)
        return cls(context, target, eye, np.log(share).astype("f4"))

    def arrays(self) -> list[np.ndarray]:
        return [self.context, self.target, self.places, self.bias]

    def rows(self) -> np.ndarray:
        """All parameters as rows: contexts, targets with their bias at the end, places."""
        wide = [np.pad(self.context, ((0, 0), (0, 1))), np.hstack([self.target, self.bias[:, None]]), np.pad(self.places.reshape(-1, self.places.shape[-1]), ((0, 0), (0, 1)))]
        return np.concatenate(wide)

    def from_rows(self, rows: np.ndarray) -> Bilinear:
        n, m = len(self.context), len(self.context) + len(self.target)
        rows = rows.astype("f4")
        return Bilinear(rows[:n, :-1].copy(), rows[n:m, :-1].copy(), rows[m:, :-1].reshape(self.places.shape), rows[n:m, -1].copy())


def sum_by(index: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct indices, sums of their values)."""
    order = np.argsort(index.astype(np.uint16) if index.max() < 65536 else index, kind="stable")
    ranked = index[order]
    first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    return ranked[first], np.add.reduceat(values[order], first, axis=0)


class Trainer:
    """Noise-contrastive estimation with noise shared by a batch, adaptive step sizes. Only the vectors
    that a batch meets are touched; ``met`` counts how often."""

    def __init__(self, model: Bilinear, share: np.ndarray, contexts: np.ndarray, rate: float, noise: int, batch: int = 4096, seed: int = 0):
        self.m = Bilinear(*(x.copy() for x in model.arrays()))
        self.contexts, self.rate, self.noise, self.batch = contexts, rate, noise, batch
        self.rng = np.random.default_rng(seed)
        self.log_noise = np.log(noise * share).astype("f4")
        self.steps = np.cumsum(share)
        self.squares = [np.full(x.shape, 1e-2, "f4") for x in self.m.arrays()]
        self.met = [np.zeros(len(self.m.context), np.int64), np.zeros(len(self.m.target), np.int64)]
        self.waiting: list[np.ndarray] = []
        self.held = 0
        self.seen = 0

    def add(self, kinds: np.ndarray) -> None:
        """One text's targets, after two ends."""
        self.waiting.append(kinds)
        self.held += len(kinds) - 2
        if self.held >= 16 * self.batch:
            self.flush()

    def flush(self) -> None:
        if not self.held:
            return
        a, b, w = (np.concatenate([k[i : len(k) - 2 + i] for k in self.waiting]) for i in range(3))
        order = self.rng.permutation(len(w))
        for at in range(0, len(w), self.batch):
            pick = order[at : at + self.batch]
            self.step(self.contexts[a[pick]], self.contexts[b[pick]], w[pick])
        self.waiting, self.held = [], 0

    def climb(self, k: int, at, gradient: np.ndarray) -> None:
        x, s = self.m.arrays()[k], self.squares[k]
        s[at] += gradient * gradient
        x[at] += self.rate * gradient / np.sqrt(s[at])

    def step(self, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> None:
        m = self.m
        noise = np.minimum(np.searchsorted(self.steps, self.rng.random(self.noise)), len(m.bias) - 1)
        ca, cb = m.context[a], m.context[b]
        h = ca @ m.places[0] + cb @ m.places[1]
        tw, tn = m.target[w], m.target[noise]
        pos = np.einsum("ij,ij->i", h, tw) + m.bias[w] - self.log_noise[w]
        neg = h @ tn.T + (m.bias[noise] - self.log_noise[noise])
        up = 1 / (1 + np.exp(np.clip(pos, -30, 30)))
        down = -1 / (1 + np.exp(-np.clip(neg, -30, 30)))
        gh = up[:, None] * tw + down @ tn
        scale = np.float32(1 / len(w))
        pull = np.hstack([np.concatenate([up[:, None] * h, down.T @ h]), np.concatenate([up, down.sum(0)])[:, None]])
        targets, pull = sum_by(np.concatenate([w, noise]), pull * scale)
        contexts, push = sum_by(np.concatenate([a, b]), np.concatenate([gh @ m.places[0].T, gh @ m.places[1].T]) * scale)
        places = np.stack([ca.T @ gh, cb.T @ gh]) * scale
        self.climb(0, contexts, push)
        self.climb(1, targets, pull[:, :-1])
        self.climb(2, slice(None), places)
        self.climb(3, targets, pull[:, -1])
        self.met[0][contexts] += 1
        self.met[1][targets] += 1
        self.seen += len(w)

    def weights(self) -> np.ndarray:
        """How often each of the model's rows was touched."""
        return np.concatenate([*self.met, np.full(self.m.places.shape[0] * self.m.places.shape[1], self.seen)])


def normalisers(model: Bilinear, rows: np.ndarray, block: int = 2048) -> np.ndarray:
    """log Z of the given context classes, as the nearer to the start, and all classes: natural logs."""
    left = model.context[rows] @ model.places[0]
    right = model.context @ model.places[1]
    high, low = np.full(len(left), -np.inf, "f4"), np.full(len(right), -np.inf, "f4")
    for at in range(0, len(model.bias), block):
        t, b = model.target[at : at + block], model.bias[at : at + block]
        high, low = np.maximum(high, (left @ t.T).max(1)), np.maximum(low, (right @ t.T + b).max(1))
    total = np.zeros((len(left), len(right)))
    for at in range(0, len(model.bias), block):
        t, b = model.target[at : at + block], model.bias[at : at + block]
        total += np.exp(left @ t.T - high[:, None]) @ np.exp(right @ t.T + b - low[:, None]).T
    return np.log(np.maximum(total, 1e-37)) + high[:, None] + low


def all_normalisers(spark: SparkSession, model: Bilinear, step: int = 128) -> np.ndarray:
    """The square table of log Z, its rows dealt to tasks; its size depends on the number of context
    classes only."""
    shared, n = spark.sparkContext.broadcast(model), len(model.context)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in batch.column(0).to_pylist():
                z = normalisers(shared.value, np.arange(first, min(n, first + step))).astype("<f4")
                yield pa.RecordBatch.from_arrays([pa.array([first]), pa.array([z.tobytes()], pa.binary())], names=["first", "z"])

    parts = spark.range(0, n, step, -(-n // step)).mapInArrow(task, "first long, z binary").collect()
    return np.concatenate([np.frombuffer(r.z, "<f4").reshape(-1, n) for r in sorted(parts)])


class Scorer:
    def __init__(self, words: Words, model: Bilinear, normal: np.ndarray):
        self.words, self.normal, self.target, self.bias = words, normal, model.target, model.bias
        self.left, self.right = model.context @ model.places[0], model.context @ model.places[1]
        self.contexts = words.contexts()
        self.frequent_base, self.frequent_inside = words.base(words.count), words.inside()
        self.known = Generations(250_000)

    def log10(self, kinds: np.ndarray) -> float:
        """log10 probability of a sequence of targets, after two ends."""
        near = self.contexts[kinds[:-1]]
        a, b, w, total = near[:-1], near[1:], kinds[2:], 0.0
        for at in range(0, len(w), 1 << 15):  # bounds what a very long text gathers at once
            i, j, k = (x[at : at + (1 << 15)] for x in (a, b, w))
            total += float((np.einsum("ij,ij->i", self.left[i] + self.right[j], self.target[k]) + self.bias[k] - self.normal[i, j]).sum(dtype=float))
        return total / np.log(10)


_scorers: dict = {}


def count_words(docs: DataFrame, hold: int = 200_000) -> DataFrame:
    """(word, c) over the training rows of (text binary, held_out); counted in the task first."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "c"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(tokens_of(text))
                if len(counts) > hold:
                    yield out()
                    counts.clear()
        yield out()

    counted = docs.where("not held_out").select("text").mapInArrow(task, "word string, c long")
    return counted.groupBy("word").agg(F.sum("c").alias("c"))


def shared_class(word) -> F.Column:
    return (F.crc32(F.encode(F.right(word, F.lit(3)), "UTF-8")) % SHARED).cast("int")


def know_words(counts: DataFrame, own: int, targets: int, frequent: int) -> Words:
    """Only words above a count that leaves at most ``frequent`` of them come to the driver."""
    total = counts.agg(F.sum("c"), F.count("*"), F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)).first()
    level = F.floor(F.log2("c") * 16).cast("int")  # some hundred levels of counts
    least = 0
    for r in counts.groupBy(level.alias("at")).agg(F.count("*").alias("n")).orderBy(F.desc("at")).collect():
        frequent -= r.n
        least = r["at"]
        if frequent < 0:
            least += 1
            break
    top = counts.where(level >= least).toLocalIterator()
    top = sorted(((r.word, r.c) for r in top), key=lambda r: (-r[1], r[0]))
    targets = min(targets, len(top))
    tokens, types = np.zeros(targets + SHARED), np.zeros(targets + SHARED)
    for r in counts.groupBy(shared_class("word").alias("k")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect():
        tokens[targets + r.k], types[targets + r.k] = r.n, r.v
    kind = np.zeros(len(top), np.int64)
    for i, (word, c) in enumerate(top):
        kind[i] = targets + class_of(word)
        if i < targets:
            tokens[kind[i]] -= c
            types[kind[i]] -= 1
            tokens[i] = c
            kind[i] = i
    place = {word.encode(): i for i, (word, _) in enumerate(top)}
    discount = total[2] / (total[2] + 2 * total[3]) if total[2] and total[3] else 0.5
    return Words(place, kind, np.array([c for _, c in top], np.int64), own, targets, total[0] or 0, total[1], discount, tokens, types)


def train(docs: DataFrame, words: Words, size: int, noise: int, warm_docs: int, warm_tokens: int, rate: float) -> Bilinear:
    """The model from the training rows of (doc_id, text binary, held_out). The warm start takes training
    texts in the order of a hash of id and text until it has ``warm_docs`` of them or ``warm_tokens``
    tokens; what the model is then depends on how Spark deals the rows to tasks, as averaging does."""
    spark = docs.sparkSession
    share = (words.class_tokens + 0.5) / (words.class_tokens + 0.5).sum()
    model = Bilinear.start(share, words.own + SHARED, size)
    if not words.total:
        return model
    known_words = spark.sparkContext.broadcast(words)
    training = docs.where("not held_out")

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, known = known_words.value, Generations(250_000)
        for batch in batches:
            texts = map(tokens_of, batch.column(1).to_pylist())
            rows = [lexicon.kinds(t, lexicon.places(t), known).astype("<i4").tobytes() for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], names=["at", "kinds"])

    ends = words.place.get(END)
    share_of_docs = warm_docs / max(1, int(words.count[ends]) if ends is not None else 1)  # END closes each training text
    at = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30))
    drawn = training.select(at.alias("at"), "text").where(F.col("at") < int(min(1.0, 1.2 * share_of_docs) * (1 << 30)))
    found, held = [], 0
    contexts = words.contexts()
    trainer = Trainer(model, share, contexts, rate, noise)
    for r in drawn.orderBy("at").limit(warm_docs).mapInArrow(classes, "at long, kinds binary").orderBy("at").toLocalIterator():
        found.append(np.frombuffer(r.kinds, "<i4").astype(np.int64))
        held += len(found[-1])
        if held > warm_tokens:
            break
    for _ in range(2):
        for k in found:
            trainer.add(k)
        trainer.flush()
    shared = spark.sparkContext.broadcast((trainer.m, share, contexts))

    def refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        warm, of, near = shared.value
        own = Trainer(warm, of, near, rate / 3, noise)
        lexicon, known = known_words.value, Generations(250_000)
        seeded = False
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if not seeded:  # tasks draw noise of their own, the same in each try
                    own.rng, seeded = np.random.default_rng(zlib.crc32(text or b"")), True
                t = tokens_of(text)
                own.add(lexicon.kinds(t, lexicon.places(t), known))
        own.flush()
        weight = own.weights()
        rows = np.flatnonzero(weight)
        if len(rows):
            moved = own.m.rows()[rows].astype("f8").T * weight[rows]
            columns = [pa.array(rows), pa.array(weight[rows]), *(pa.array(c) for c in moved)]
            yield pa.RecordBatch.from_arrays(columns, names=["at", "n", *names])

    names = [f"p{i}" for i in range(size + 1)]
    parts = training.select("text").mapInArrow(refine, "at long, n long, " + ", ".join(f"{p} double" for p in names))
    mean = parts.groupBy("at").agg(*((F.sum(p) / F.sum("n")).alias(p) for p in names)).collect()
    rows = trainer.m.rows()
    for r in mean:
        rows[r["at"]] = r[1:]
    return trainer.m.from_rows(rows)


def score_documents(
    docs: DataFrame,
    own: int = 1536,
    targets: int = 1536,
    frequent: int = 100_000,
    size: int = 32,
    noise: int = 256,
    warm_docs: int = 3_000,
    warm_tokens: int = 3_000_000,
    rate: float = 0.15,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)."""
    spark = docs.sparkSession
    held = F.coalesce(F.crc32(F.col(id_col).cast("long").cast("string")) % 5 == 1, F.lit(False))
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.encode(F.col(text_col), "UTF-8").alias("text"), held.alias("held_out"))
    counts = stored(count_words(slim), "words")
    words = know_words(counts, own, targets, frequent)
    model = train(slim, words, size, noise, warm_docs, warm_tokens, rate)
    shared = spark.sparkContext.broadcast((words, model, all_normalisers(spark, model)))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = shared.value[0]
        key = id(lexicon)
        if key not in _scorers:
            _scorers.clear()
            _scorers[key] = Scorer(*shared.value)
        scorer = _scorers[key]
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            out = []
            for doc_id, held_out, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                tokens = tokens_of(text)
                places = lexicon.places(tokens)
                score = scorer.log10(lexicon.kinds(tokens, places, scorer.known))
                found = places[places >= 0]
                base, inside = scorer.frequent_base[found].sum(), scorer.frequent_inside[found].sum()
                rare = Counter([tokens[i] for i in np.flatnonzero(places < 0).tolist()])
                out.append((row, doc_id, held_out, len(tokens), len(found), float(base), float(inside + score), list(rare), list(rare.values())))
                row += 1
            kinds_of = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int32())]
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds_of, strict=True)] if out else [pa.array([], t) for t in kinds_of]
            columns[7] = columns[7].cast(pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "words", "times"])

    schema = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, words array<string>, times array<int>"
    part = stored(slim.select("doc_id", "held_out", "text").mapInArrow(task, schema), "scores")
    kinds = [(k, float(words.class_tokens[words.targets + k]), float(words.class_types[words.targets + k])) for k in range(SHARED)]
    of_class = F.broadcast(spark.createDataFrame(kinds, "k int, class_n double, class_v double"))
    rare = part.select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select("row", F.col("w.words").alias("word"), F.col("w.times").alias("times"))
    met = rare.join(counts, "word", "left").withColumn("k", shared_class("word")).join(of_class, "k")
    count = F.coalesce(F.col("c"), F.lit(0))
    mass = F.when(count > 0, count - words.discount).otherwise(words.discount * F.col("class_v"))
    inside = F.when(F.col("class_n") > 0, F.log10(mass / F.col("class_n"))).otherwise(0.0)
    base = F.log10((count + 0.5) / (words.total + 0.5 * (words.types + 1)))
    sums = met.groupBy("row").agg(
        F.sum(F.when(count > 0, F.col("times")).otherwise(0)).alias("more_known"), F.sum(base * F.col("times")).alias("more_base"), F.sum(inside * F.col("times")).alias("more_score")
    )
    return part.drop("words", "times").join(sums, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(words.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"),
    )
