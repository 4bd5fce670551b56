"""Operator 8: toxicity by a weighted finite-state pattern grammar.

Words are read as classes: insult stems and words (learned from labelled rows, each with a weight),
threats (their weight is learned too, where labels show one), targets, negations, reported speech, clause ends. One small
weighted transducer each says
what a class does: the insult and threat transducers emit weight, those of target, negation and
reported speech rescale what is emitted in their clause. Their composition (the product
of their states) is one transducer, which reads each clause forward and backward, so that what stands on either side of a match is
in its state: "you are a ..., he said" weighs less than "you are a ...", "i will kill you" more than "kill the lights". The factors of
target, negation, report and aimless threats are chosen on the labels, from a few values each. A logistic regression turns a
text's clause scores into a probability.

Learning takes at most ``sample`` labelled rows, those with the smallest id hashes: the documented
bound of the fit. Everything else reads all rows. The label, language, source and id of a row are no
inputs of its score.

Null and empty texts match no clause and get the score of such a text. Repeated rows are scored row
by row. Rows without a label are only scored; a row without id is not held out, and no label is its own. Without any usable label the model has no stems and a
score of 0. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructType

from haltbook.llm.common import Generations, stored

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, BREAK = range(7)
NOTHING = (OTHER, 0.0)
#: Words of which a worker keeps what they are, and texts that it takes at a time.
KNOWN, TEXTS = 50_000, 1000

#: Fixed word lists of the grammar.
THREATS = "stab stabs stabbed beat beats beaten töte tötet getötet mato mataré tue tuerai".split()
THREAT_STEMS = "kill destroy hurt crush burn shoot strangl punish töten zerstör matar destru tuer détrui".split()
TARGETS = "you your yours yourself he she they them du dich ihr sie tu vous toi usted ustedes ellos".split()
NEGATIONS = "not never no isn't aren't wasn't don't nicht kein keine nie ne pas jamais nunca".split()
REPORTS = "said says called calls wrote quoted claims reported sagte dijo llamó dit appelle".split()

TOKEN = re.compile(r"[^\W_]+(?:'[^\W_]+)?|[.!?;\n]")


@dataclass(frozen=True)
class Machine:
    """A weighted transducer over word classes: moves give the state after (state, class), factors what is emitted there. A
    missing move keeps the state, a missing factor is 1. State 0 is the start; a higher state knows more."""

    states: int
    moves: dict = field(default_factory=dict)
    factors: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Grammar:
    """The composition of machines."""

    start: tuple
    moves: dict  # (states, class): states
    factors: dict  # (states, class): product of the factors


def compose(machines: list[Machine]) -> Grammar:
    """The product of the machines."""
    moves, factors = {}, {}
    for states in product(*(range(m.states) for m in machines)):
        for kind in range(7):
            own = list(zip(machines, states, strict=True))
            moves[states, kind] = tuple(m.moves.get((s, kind), s) for m, s in own)
            factors[states, kind] = float(np.prod([m.factors.get((s, kind), 1.0) for m, s in own]))
    return Grammar((0,) * len(machines), moves, factors)


#: What the factors may be; the first of each is taken unless another fits the labels better.
CHOICES = {"aimed": (1.5, 1.0, 2.5), "denied": (0.4, 0.2, 1.0), "quoted": (0.6, 0.3, 1.0), "aimless": (0.3, 0.1)}


def grammar(aimed: float = 1.5, denied: float = 0.4, quoted: float = 0.6, aimless: float = 0.3) -> Grammar:
    """Classes other than insult and threat emit nothing, so factors matter for these two only."""

    def scope(kind: int, factor: float) -> Machine:
        return Machine(2, {(0, kind): 1, (1, BREAK): 0}, {(1, INSULT): factor, (1, THREAT): factor})

    threat = Machine(2, {(0, TARGET): 1, (1, BREAK): 0}, {(0, THREAT): aimless})
    return compose([threat, scope(TARGET, aimed), scope(NEGATION, denied), scope(REPORT, quoted)])


@dataclass
class Lexicon:
    """Insult stems (word beginnings) and whole words with their weights."""

    stems: dict[str, float]
    words: dict[str, float]
    longest: int = 9

    def read(self, token: str) -> tuple[int, float]:
        if token in ".!?;\n":
            return BREAK, 0.0
        weight = self.words.get(token, 0.0)
        for n in range(3, min(self.longest, len(token)) + 1):
            weight = max(weight, self.stems.get(token[:n], 0.0))
        if token in THREATS or token.startswith(tuple(THREAT_STEMS)):
            return THREAT, max(weight, 1.0)
        for kind, listed in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)):  # what directs a match is none itself
            if token in listed:
                return kind, 1.0
        return (INSULT, weight) if weight else NOTHING


def states_before(kinds: list[int], g: Grammar) -> list[tuple]:
    """The grammar's states in front of each class."""
    out, state = [], g.start
    for kind in kinds:
        out.append(state)
        state = g.moves[state, kind]
    return out


def clause_features(read: list[tuple[int, float]], g: Grammar, n_tokens: int) -> list[float]:
    """Of one text: strongest clause, and by length the sum of clauses, their squares, matches."""
    kinds = [k for k, _ in read]
    forward, backward = states_before(kinds, g), states_before(kinds[::-1], g)[::-1]
    own, clauses, hits = 0.0, [], 0
    for (kind, weight), left, right in zip(read, forward, backward, strict=True):
        if kind in (INSULT, THREAT):
            own += weight * g.factors[tuple(map(max, left, right)), kind]
            hits += 1
        elif kind == BREAK:
            if own:
                clauses.append(own)
            own = 0.0
    if own:
        clauses.append(own)
    if not clauses:
        return [0.0] * 4
    size = n_tokens + 20
    dense = np.log1p([100 * sum(clauses) / size, 100 * sum(c * c for c in clauses) / size, 100 * hits / size])
    return [max(clauses), *dense.tolist()]


_machines: dict = {}


def _features(texts: list[str | None], lexicon: Lexicon, grammars: list[Grammar], known: Generations) -> np.ndarray:
    """Texts x (four features for each of the grammars)."""
    out = []
    for text in texts:
        tokens = TOKEN.findall((text or "").lower())
        known.turn()
        young = known.young
        for t in known.missing(tokens):
            young[t] = lexicon.read(t)
        read = [x for x in map(young.__getitem__, tokens) if x[0]]
        matched = any(k in (INSULT, THREAT) for k, _ in read)
        out.append([x for g in grammars for x in (clause_features(read, g, len(tokens)) if matched else [0.0] * 4)])
        for t in [t for t in young if len(t) > 64] if len(text or "") > 100_000 else ():
            del young[t]
    return np.array(out, float).reshape(-1, 4 * len(grammars))


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray  # bias first
    factors: dict = field(default_factory=dict)  # of the grammar

    def score(self, texts: list[str | None]) -> np.ndarray:
        key = id(self)
        if key not in _machines:
            _machines.clear()
            _machines[key] = (self, [grammar(**self.factors)], Generations(KNOWN))
        _, table, known = _machines[key]
        x = _features(texts, self.lexicon, table, known)
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + x @ self.weights[1:], -30, 30)))


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """(text, toxic) of at most ``sample`` labelled rows outside the held-out remainder."""
    chosen = (
        labels.where("toxic is not null and doc_id is not null and crc32(cast(doc_id as string)) % 4 <> 2")
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return found.groupBy("text").agg(F.max("toxic").alias("toxic"))  # copies would make chance words look certain


def learn_lexicon(rows: DataFrame, support: float, odds: float, longest: int) -> Lexicon:
    """Word beginnings and words that toxic texts have and others lack; ``support`` is the least
    share of the toxic texts (and three texts). Counts are Spark's; the driver gets the entries that
    reach the support: at most the distinct entries of a text, divided by ``support``, on average."""
    words = F.array_distinct(F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}']+"), lambda w: F.length(w) >= 3))
    starts = F.sequence(F.lit(3), F.lit(longest))
    marks = F.flatten(F.transform(words, lambda w: F.array_append(F.transform(starts, lambda n: F.substr(w, F.lit(1), n)), F.concat(w, F.lit("$")))))
    spread = rows.select("toxic", F.explode(F.array_distinct(marks)).alias("mark"))
    counts = spread.groupBy("mark").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))
    total = rows.agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good")).first()
    n_bad, n_good = (total.bad or 0) + 1, (total.good or 0) + 1
    weight = F.log((F.col("bad") + 0.5) / n_bad) - F.log((F.col("good") + 0.5) / n_good)
    kept = counts.where(F.col("bad") >= max(3, support * n_bad)).withColumn("weight", weight).where(F.col("weight") >= odds)
    stems, whole = {}, {}
    for r in kept.collect():
        if r.mark.endswith("$"):
            whole[r.mark[:-1]] = r.weight
        else:
            stems[r.mark] = r.weight
    return Lexicon(stems, whole, longest)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.01, rounds: int = 2_000) -> tuple[np.ndarray, float]:
    """(bias and weights, mean log-likelihood less the ridge), by projected gradient ascent with step control. Weights stay at or above
    zero, since every feature is evidence for the label: a stronger match never lowers a score."""
    scale = np.maximum(x.std(0), 1e-9)
    a, w, rate = np.hstack([np.ones((len(x), 1)), x / scale]), np.zeros(x.shape[1] + 1), 1.0
    w[0] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))

    def value(w: np.ndarray) -> float:
        z = a @ w
        return float((y * z - np.logaddexp(0, z)).mean() - ridge / 2 * (w[1:] ** 2).sum() / len(y) ** 0.5)

    now = value(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = a.T @ (y - p) / len(y)
        step[1:] -= ridge * w[1:] / len(y) ** 0.5
        while rate > 1e-9:
            new = w + rate * step
            new[1:] = np.maximum(new[1:], 0)
            if (then := value(new)) >= now:
                break
            rate /= 2
        if then - now < 1e-10:
            break
        w, now, rate = new, then, rate * 1.5
    return np.concatenate([w[:1], w[1:] / scale]), now


def train(docs: DataFrame, labels: DataFrame, sample: int = 10_000, support: float = 0.02, odds: float = 1.0, longest: int = 9) -> Model:
    """Fit on at most ``sample`` labelled rows. The features of those rows (four numbers for each of eight grammars and a
    label each) come to the driver for the logistic fits: one with the first factors, one with each other value of each;
    a factor is changed if that raises the likelihood."""
    rows = stored(labelled_sample(docs, labels, sample), "labelled")  # read three times
    lexicon = learn_lexicon(rows, support, odds, longest)
    if not lexicon.stems and not lexicon.words:
        return Model(lexicon, np.array([-30.0, 0, 0, 0, 0]))
    tried = [{}, *({name: v} for name, values in CHOICES.items() for v in values[1:])]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, grammars = Generations(KNOWN), [grammar(**t) for t in tried]
        for batch in batches:
            x = _features(batch.column(0).to_pylist(), lexicon, grammars, known)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), batch.column(1)], names=["x", "toxic"])

    found = rows.select("text", F.col("toxic").cast("long").alias("toxic")).mapInArrow(task, "x binary, toxic long").collect()
    x = np.array([np.frombuffer(r.x) for r in found]).reshape(len(found), len(tried), 4)
    y = np.array([r.toxic for r in found], float)
    start, first = fit_logistic(x[:, 0], y)
    gained = {}
    for k, t in enumerate(tried[1:], 1):
        _, value = fit_logistic(x[:, k], y, rounds=300)
        ((name, v),) = t.items()
        if value > max(first + 1e-4, gained.get(name, (first, None))[0]):
            gained[name] = value, v
    if not gained:
        return Model(lexicon, start)
    factors = {name: v for name, (_, v) in gained.items()}
    best = labelled_features(rows, lexicon, factors)
    return Model(lexicon, fit_logistic(best[:, :4], best[:, 4])[0], factors)


def labelled_features(rows: DataFrame, lexicon: Lexicon, factors: dict) -> np.ndarray:
    """Features and label of the labelled rows under one grammar."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, grammars = Generations(KNOWN), [grammar(**factors)]
        for batch in batches:
            x = _features(batch.column(0).to_pylist(), lexicon, grammars, known)
            yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in x.T), batch.column(1)], names=["a", "b", "c", "d", "toxic"])

    found = rows.select("text", F.col("toxic").cast("long").alias("toxic")).mapInArrow(task, "a double, b double, c double, d double, toxic long")
    return np.array([tuple(r) for r in found.collect()], float).reshape(-1, 5)


def score_documents(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The columns of ``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from the threshold on);
    columns of these names are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.drop("score", "predicted")
    schema = StructType([*kept.schema.fields]).add("score", DoubleType()).add("predicted", IntegerType())

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = shared.value
        for batch in batches:
            texts = batch.column("text")
            s = np.concatenate([judge.score(texts.slice(k, TEXTS).to_pylist()) for k in range(0, len(texts), TEXTS)] or [np.zeros(0)])
            columns = [*batch.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "score", "predicted"])

    return kept.mapInArrow(task, schema)


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = 10_000, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    model = train(docs, labels, sample)
    scored = score_documents(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model, threshold)
    return scored.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)).alias("held_out"), "score", "predicted")
