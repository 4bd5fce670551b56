"""A label model for labelers that vote 1, -1 or abstain (0).

Spark counts the vote patterns; with k labelers there are at most 3**k of them, so the table that
expectation-maximisation works on is bounded whatever the input. Each labeler's reliability is the
probability of each vote given the hidden class; pseudo-counts are ``smooth`` rows a vote, whatever the
size of the data.

Labelers that say the same for the same reason would be counted twice. Once the classes have settled, a
labeler's weight is divided by one plus its squared correlations with the others inside the classes (the
variance they share), and the classes settle again.

``fit`` knows one bad class. ``fit_kinds`` lets bad rows be of several kinds, which rules tell apart:
rules whose negative votes go together (correlation of at least ``tied``) describe one kind, and so does a rule whose
negative votes go with no other's, as long as the classes leave it rows. With one
bad class for all, the most common kind would take it whole and the others would pass as good.
Results are log-odds weights per labeler and vote, applied again as a plain column expression.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOTES = (-1, 0, 1)

Model = tuple[float, list[dict[int, float]]]


def count_patterns(votes: DataFrame, names: list[str]) -> list[tuple[tuple[int, ...], int]]:
    return [(tuple(int(r[n]) for n in names), r["n_rows"]) for r in votes.groupBy(*names).agg(F.count("*").alias("n_rows")).collect()]


def correlations(values: np.ndarray, parts: list[np.ndarray]) -> np.ndarray:
    """Of the columns inside the parts (row masses), pooled."""
    both = 0
    for part in parts:
        centred = values - (values * part[:, None]).sum(0) / max(part.sum(), 1e-9)
        both = both + (centred * part[:, None]).T @ centred
    spread = np.sqrt(np.maximum(np.diag(both), 1e-9))
    return both / np.outer(spread, spread)


def settle(votes: np.ndarray, mass: np.ndarray, sure: np.ndarray, rounds: int, smooth: float) -> tuple[np.ndarray, np.ndarray]:
    """(log shares, classes x labelers x votes log-odds against class 0) from first responsibilities,
    patterns x classes."""
    at, k = votes + 1, np.arange(votes.shape[1])
    divide = np.ones(len(k))
    for again in range(2):
        for _ in range(rounds):
            if again:
                tied = np.clip(correlations(votes, list((sure * mass[:, None]).T)), 0, 1) ** 2
                divide = 1 + tied.sum(1) - np.diag(tied)
            own = sure * mass[:, None]
            share = np.log((own.sum(0) + smooth) / (mass.sum() + smooth * sure.shape[1]))
            seen = np.stack([np.einsum("pc,pk->ck", own, votes == v) for v in VOTES], axis=2) + smooth
            chance = np.log(seen / seen.sum(2, keepdims=True))
            weight = (chance - chance[:1]) / divide[:, None]
            score = share + weight[:, k, at].sum(2).T
            new = np.exp(score - score.max(1, keepdims=True))
            new /= new.sum(1, keepdims=True)
            moved, sure = np.abs(new - sure).max(), new
            if moved < 1e-9:
                break
    return share, weight


def arrays(patterns: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, np.ndarray]:
    patterns = sorted(patterns)
    return np.array([p for p, _ in patterns]), np.array([n for _, n in patterns], float)


def against(share: np.ndarray, weight: np.ndarray, c: int) -> Model:
    """Prior log-odds of class 0 against class c and the weights of each labeler's votes."""
    return float(share[0] - share[c]), [{v: float(-w[v + 1]) for v in VOTES} for w in weight[c]]


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 200, smooth: float = 1.0) -> Model:
    """(prior log-odds of class 1, weight of each labeler's votes). Class 1 starts from the rows with more
    votes for it than the average."""
    if not sum(n for _, n in patterns):
        return 0.0, []
    votes, mass = arrays(patterns)
    net = votes.sum(1)
    good = 1 / (1 + np.exp(-(net - net @ mass / mass.sum())))
    return against(*settle(votes, mass, np.stack([good, 1 - good], axis=1), rounds, smooth), 1)


def kinds_of(votes: np.ndarray, mass: np.ndarray, tied: float) -> list[list[int]]:
    """Groups of rules whose negative votes go together, rules that stand alone among them; none if all do."""
    near = correlations((votes == -1).astype(float), [mass]) >= tied
    left, out = set(range(votes.shape[1])), []
    while left:
        group = [left.pop()]
        for k in group:
            more = [j for j in left if near[k, j]]
            group += more
            left -= set(more)
        if (votes[:, group] == -1).any():
            out.append(sorted(group))
    return out if any(len(g) > 1 for g in out) else []


def fit_kinds(patterns: list[tuple[tuple[int, ...], int]], tied: float = 0.2, rounds: int = 200, smooth: float = 1.0) -> list[Model]:
    """One model for each kind of bad row: good rows against it."""
    if not sum(n for _, n in patterns):
        return []
    votes, mass = arrays(patterns)
    kinds = kinds_of(votes, mass, tied)
    if not kinds:
        return [fit(patterns, rounds, smooth)]
    hit = np.stack([(votes[:, g] == -1).mean(1) for g in kinds], axis=1) * 20
    first = np.hstack([np.ones((len(votes), 1)), hit + 0.05])
    share, weight = settle(votes, mass, first / first.sum(1, keepdims=True), rounds, smooth)
    left = np.exp(share) * mass.sum() >= 2 * smooth  # the others have been emptied
    return [against(share, weight, c + 1) for c in range(len(kinds)) if left[c + 1]]


def odds_of(model: Model, pattern: tuple[int, ...]) -> float:
    return model[0] + sum(w[v] for w, v in zip(model[1], pattern, strict=True))


def odds_column(model: Model, names: list[str]) -> Column:
    start, weights = model
    odds = F.lit(start)
    for name, w in zip(names, weights, strict=False):
        odds = odds + F.when(F.col(name) == 1, w[1]).when(F.col(name) == -1, w[-1]).otherwise(w[0])
    return odds


def posterior(models: list[Model], names: list[str]) -> Column:
    """Probability of the good class from the vote columns, against all kinds of bad rows."""
    bad = F.lit(0.0)
    for model in models:
        bad = bad + F.exp(-odds_column(model, names))
    return F.lit(1.0) / (F.lit(1.0) + bad)
