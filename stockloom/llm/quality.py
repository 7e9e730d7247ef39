"""Quality by weak labels: heuristic labellers, expectation-maximisation, a hashed linear scorer.

Labellers vote good, bad or nothing on a text from counts over the whole text.  The votes of
all texts are counted by pattern (a bounded table), and EM estimates how often each labeller
is right on good and on bad texts, and the share of good ones.  Every text then carries the
posterior of its pattern as a soft label.  The scorer is linear in hashed words and word
shapes; its weights are log-odds of soft counts, one pass over all texts and a table of fixed
size.  A logistic curve over the mean weight is fitted to the posteriors.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import column, hash_words, mix, slices, word_ends

FEATURES = 1 << 17
KEEP_FROM = 0.5
#: A word is new if it is not among so many words before it, so long texts are judged like short ones.
WINDOW = 200

# Frequent function words.
FUNCTION_WORDS = ("the of and to in is that for it was on are as with be by this from or an at "
                  "der die das und in zu den von mit ist im für auf nicht ein eine des dem sich als "
                  "le la les de des et en un une du que qui dans est pour pas sur par avec au "
                  "el los las del y que en una por con para es su al lo como se no").split()

LABELLERS = ("symbols", "capitals", "repeats", "variety", "function_words", "word_length", "sentences", "wordless")

_U = np.uint64
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LETTER[128:] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_PLAIN = np.zeros(256, bool)
_PLAIN[[32, 9, 10, 11, 12, 13, *b".,;:'\"?-()"]] = True
_SYMBOL = ~(_LETTER | _PLAIN)
_SYMBOL[48:58] = False
_known = None


def _function_hashes() -> np.ndarray:
    global _known
    if _known is None:
        text = " ".join(sorted(set(FUNCTION_WORDS))).encode()
        _known = np.sort(hash_words(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[1])
    return _known


def _new(values: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Whether each value is not among the WINDOW values before it in its row; sorted by row."""
    order = np.lexsort((values, rows))  # stable: equal values of a row by position
    new = np.ones(len(values), bool)
    new[1:] = (values[order][1:] != values[order][:-1]) | (rows[order][1:] != rows[order][:-1]) | (np.diff(order) > WINDOW)
    return new


def _read(data: np.ndarray, at: np.ndarray):
    """Votes (rows x labellers: 1 good, 0 bad, -1 none), word features, and each row's word bounds."""
    starts, words = hash_words(data, at)
    ends = word_ends(data, at)
    bounds = np.searchsorted(starts, at)
    n = np.diff(bounds)
    rows = np.repeat(np.arange(len(n)), n)

    def total(values, by=None) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
        edge = at if by is None else by
        return (sums[edge[1:]] - sums[edge[:-1]]).astype(np.float64)

    letter = np.concatenate(([0], np.cumsum(_LETTER[data], dtype=np.int64)))
    lettered = letter[ends] - letter[starts]
    symbol = np.concatenate(([0], np.cumsum(_SYMBOL[data], dtype=np.int64)))
    marked = symbol[ends] - symbol[starts]
    again = np.zeros(len(words), bool)
    again[1:] = (words[1:] == words[:-1]) & (rows[1:] == rows[:-1])
    known = _function_hashes()
    place = np.minimum(np.searchsorted(known, words), len(known) - 1)
    last = data[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    stop = (last == 46) | (last == 33) | (last == 63)
    new = _new(words, rows)
    size = np.maximum(n, 1)
    letters = np.maximum(total(_LETTER[data]), 1)
    share = {"symbols": total(_SYMBOL[data]) / size, "capitals": total(_UPPER[data]) / letters, "repeats": total(again, bounds) / size,
             "variety": total(new, bounds) / size, "function_words": total(known[place] == words, bounds) / size,
             "word_length": total(lettered, bounds) / size, "sentences": total(stop, bounds) / size, "wordless": total(lettered == 0, bounds) / size}
    votes = np.full((len(n), len(LABELLERS)), -1, np.int8)

    def vote(name: str, good, bad, least: int) -> None:
        k = LABELLERS.index(name)
        votes[:, k] = np.where(n < least, -1, np.where(bad(share[name]), 0, np.where(good(share[name]), 1, -1)))

    vote("symbols", lambda x: x < 0.05, lambda x: x > 0.3, 1)
    vote("capitals", lambda x: x < 0.15, lambda x: x > 0.4, 3)
    vote("repeats", lambda x: x < 0.08, lambda x: x > 0.3, 5)
    vote("variety", lambda x: x > 0.35, lambda x: x < 0.15, 20)
    vote("function_words", lambda x: x > 0.12, lambda x: x < 0.03, 20)
    vote("word_length", lambda x: (x > 2.5) & (x < 12), lambda x: (x < 1.5) | (x > 20), 3)
    vote("sentences", lambda x: (x > 0.02) & (x < 0.35), lambda x: (x < 0.003) | (x > 0.6), 30)
    vote("wordless", lambda x: x < 0.05, lambda x: x > 0.2, 3)
    capital = _UPPER[data[starts]].astype(np.uint64) if len(starts) else np.zeros(0, np.uint64)
    full = (np.concatenate(([0], np.cumsum(_UPPER[data], dtype=np.int64)))[ends] - np.concatenate(([0], np.cumsum(_UPPER[data], dtype=np.int64)))[starts]) > 1 if len(starts) else capital
    shape = (np.minimum(marked, 3).astype(np.uint64) | capital << _U(2) | again.astype(np.uint64) << _U(3) | np.asarray(full).astype(np.uint64) << _U(4)
             | (lettered == 0).astype(np.uint64) << _U(5) | np.minimum(ends - starts, 31).astype(np.uint64) << _U(6))
    half = FEATURES // 2
    buckets = np.concatenate(((words % _U(half)).astype(np.int64), (mix(shape) % _U(half)).astype(np.int64) + half))
    return votes, buckets, np.concatenate((rows, rows)), n


def estimate(votes: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, dict]:
    """Posterior of good for each vote pattern, and the fitted accuracies.

    EM over a share of good texts and, per labeller, the chance of a right vote on good and on
    bad texts given that it votes.  It starts from labellers that are right four times in
    five, which names the classes; weak priors keep chances inside (0, 1).
    """
    share, right = 0.7, np.full((2, votes.shape[1]), 0.8)
    cast = votes >= 0
    good = votes == 1
    post = np.full(len(votes), share)
    for _ in range(rounds):
        log_good = np.log(share) + (np.where(good, np.log(right[1]), np.log(1 - right[1])) * cast).sum(axis=1)
        log_bad = np.log(1 - share) + (np.where(good, np.log(1 - right[0]), np.log(right[0])) * cast).sum(axis=1)
        new = 1 / (1 + np.exp(np.clip(log_bad - log_good, -500, 500)))
        w1, w0 = (counts * new)[:, None], (counts * (1 - new))[:, None]
        share = float(((counts * new).sum() + 7) / (counts.sum() + 10))
        right[1] = ((w1 * (good & cast)).sum(axis=0) + 8) / ((w1 * cast).sum(axis=0) + 10)
        right[0] = ((w0 * (~good & cast)).sum(axis=0) + 8) / ((w0 * cast).sum(axis=0) + 10)
        done = np.abs(new - post).max() < 1e-9 if len(post) else True
        post = new
        if done:
            break
    return post, {"good": share, **{name: (float(right[1][k]), float(right[0][k])) for k, name in enumerate(LABELLERS)}}


def _code(votes: np.ndarray) -> np.ndarray:
    return ((votes.astype(np.int64) + 1) * 3 ** np.arange(votes.shape[1])).sum(axis=1)


def _patterns(codes: np.ndarray) -> np.ndarray:
    return (codes[:, None] // 3 ** np.arange(len(LABELLERS)) % 3 - 1).astype(np.int8)


def fit(docs: DataFrame, text: str = "text") -> dict:
    """The model over all of ``docs``; no labels are read.  An empty table gives a score of 0.7 throughout."""
    spark = docs.sparkSession

    def codes(batches):
        for batch in batches:
            seen = np.zeros(3 ** len(LABELLERS), np.int64)
            for _, _, data, at in slices(column(batch, text)):
                seen += np.bincount(_code(_read(data, at)[0]), minlength=len(seen))
            hit = np.flatnonzero(seen)
            yield pa.record_batch([pa.array(hit, pa.int64()), pa.array(seen[hit], pa.int64())], ["code", "n"])

    # At most 3 ** 8 patterns.
    table = docs.select(text).mapInArrow(codes, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()
    found = np.array(sorted((row["code"], row["n"]) for row in table), np.int64).reshape(-1, 2)
    post, facts = estimate(_patterns(found[:, 0]), found[:, 1].astype(np.float64))
    soft = np.full(3 ** len(LABELLERS), facts["good"])
    soft[found[:, 0]] = post
    shared = spark.sparkContext.broadcast(soft)
    blocks = 32
    width = 2 * FEATURES // blocks

    def gather(batches):
        mass = np.zeros((2, FEATURES))
        for batch in batches:
            for _, _, data, at in slices(column(batch, text)):
                votes, buckets, rows, n = _read(data, at)
                p, even = shared.value[_code(votes)], 1 / np.maximum(n, 1)
                mass[1] += np.bincount(buckets, weights=(p * even)[rows], minlength=FEATURES)
                mass[0] += np.bincount(buckets, weights=((1 - p) * even)[rows], minlength=FEATURES)
        yield pa.record_batch([pa.array(range(blocks), pa.int32()), pa.array([x.tobytes() for x in mass.reshape(blocks, width)], pa.binary())], ["block", "mass"])

    def add(key: tuple, rows: pa.Table) -> pa.Table:
        total = np.zeros(width)
        for x in sorted(x.as_py() for x in rows.column("mass")):  # one order of addition, so reruns agree
            total += np.frombuffer(x)
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "mass": pa.array([total.tobytes()], pa.binary())})

    shape = "block int, mass binary"
    mass = np.zeros((blocks, width))
    for row in docs.select(text).mapInArrow(gather, shape).groupBy("block").applyInArrow(add, shape).collect():  # a table of fixed size
        mass[row["block"]] = np.frombuffer(row["mass"])
    bad, good = mass.reshape(2, FEATURES)
    weights = np.log((good + 0.5) / (bad + 0.5)) - math.log((good.sum() + 1) / (bad.sum() + 1))
    model = {"soft": soft, "weights": weights.astype(np.float32), "facts": facts}
    known = spark.sparkContext.broadcast(model)

    def spread(batches):
        for batch in batches:
            out = np.zeros((2, 400))
            for _, _, data, at in slices(column(batch, text)):
                mean, p = _linear(data, at, known.value)
                place = np.clip(((mean + 10) * 20).astype(np.int64), 0, 399)
                out[1] += np.bincount(place, weights=p, minlength=400)
                out[0] += np.bincount(place, weights=1 - p, minlength=400)
            yield pa.record_batch([pa.array(range(400), pa.int32()), pa.array(out[0]), pa.array(out[1])], ["place", "bad", "good"])

    both = np.zeros((400, 2))
    for row in docs.select(text).mapInArrow(spread, "place int, bad double, good double").groupBy("place").agg(F.sum("bad").alias("b"), F.sum("good").alias("g")).collect():
        both[row["place"]] = row["b"], row["g"]
    return model | {"curve": _curve(both, facts["good"])}


def _linear(data: np.ndarray, at: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray]:
    votes, buckets, rows, n = _read(data, at)
    mean = np.bincount(rows, weights=model["weights"][buckets], minlength=len(n)) / np.maximum(n, 1)
    return mean, model["soft"][_code(votes)]


def _curve(table: np.ndarray, share: float) -> tuple[float, float]:
    """(slope, offset) by Newton steps on the soft counts of bins."""
    x = (np.arange(len(table)) + 0.5) / 20 - 10
    both = table.sum(axis=1)
    w = np.array([1.0, math.log(share / (1 - share))])
    design = np.stack([x, np.ones_like(x)], axis=1)
    start = w.copy()

    def loss(w: np.ndarray) -> float:
        z = design @ w
        return float((both * np.logaddexp(0, z) - table[:, 1] * z).sum() + 0.025 * ((w - start) ** 2).sum())

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        grad = design.T @ (both * p - table[:, 1]) + 0.05 * (w - start)
        hess = design.T @ (design * (both * p * (1 - p))[:, None]) + 0.05 * np.eye(2)
        move, size = np.linalg.solve(hess, grad), 1.0
        while size > 1e-6 and loss(w - size * move) > loss(w):  # never uphill
            size /= 2
        w = w - size * move
        if np.abs(size * move).max() < 1e-9 or size <= 1e-6:
            break
    return float(max(w[0], 0.0)), float(w[1])


def score(docs: DataFrame, model: dict, text: str = "text", keep_from: float = KEEP_FROM) -> DataFrame:
    """``docs`` with posterior (of the votes), quality (the scorer, 0 to 1) and kept (quality >= ``keep_from``).

    Null text is read as empty; a text without words gets the votes of none and the curve's
    offset.  Columns of these names are replaced; others pass through.
    """
    base = docs.drop("posterior", "quality", "kept")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        slope, offset = shared.value["curve"]
        for batch in batches:
            p, q = [np.zeros(0)], [np.zeros(0)]
            for _, _, data, at in slices(column(batch, text)):
                mean, post = _linear(data, at, shared.value)
                p.append(post)
                q.append(1 / (1 + np.exp(-np.clip(slope * mean + offset, -30, 30))))
            quality = np.concatenate(q)
            yield pa.record_batch([*batch.columns, pa.array(np.concatenate(p)), pa.array(quality), pa.array(quality >= keep_from)],
                                  [*batch.schema.names, "posterior", "quality", "kept"])

    return base.mapInArrow(run, StructType([*base.schema, *StructType.fromDDL("posterior double, quality double, kept boolean")]))
