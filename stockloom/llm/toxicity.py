"""Toxicity by noisy-channel deobfuscation.

1. A character trigram model is counted over all texts: a table of fixed size whose counts
   grow with the corpus.
2. A run of characters that may hide a word (digits or symbols among letters, single letters
   set apart, letters repeated) becomes a lattice: each character may stand for itself or for
   a letter it imitates, a separator may vanish, a repeat may be one keystroke.  Viterbi takes
   the path of least cost under channel and language model.
3. Words of the restored text, and their beginnings, carry evidence learnt from labelled rows;
   the sum over a text's strongest words is calibrated to a probability.

Labels are the only supervision.  Language, source and ids are never looked at for a score.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import column, mix, slices, stored, word_sets

#: Labelled rows that the evidence is learnt from, at most; a hash of the id chooses them.
TRAIN_ROWS = 24_000
#: Hash buckets of evidence, rows a bucket needs, and words summed for a text.
FEATURES, SUPPORT, STRONGEST = 1 << 21, 2, 5
#: A beginning counts by how many different words of the text have it: one, or more.
LEVELS = 2
#: Texts that must hold a feature before it speaks for its words in place of a shorter one.
KNOWN = 5
#: Standard errors taken off a log-odds, and the least that counts as evidence.
DOUBT, WEAKEST = 3.0, 1.2
PREFIXES = range(3, 8)
TOXIC_FROM = 0.7

# The letters that a digit or symbol may imitate.
IMITATES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
            "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i"}
SEPARATORS = " .-_*~'"

_CLASSES = 64  # 0 a boundary, 1-26 letters, 27-36 digits, the rest by byte
_CLASS = np.array([37 + b % 27 for b in range(256)], np.int64)
_CLASS[[32, 9, 10, 11, 12, 13]] = 0
_CLASS[97:123] = _CLASS[65:91] = np.arange(1, 27)
_CLASS[48:58] = np.arange(27, 37)
_STAND, _IMITATE, _SKIP, _REPEAT, _SPLIT = 0.0, 1.0, 0.6, 0.3, 0.0

_HIDES = re.compile(r"(?:(?<!\S)[^\W\d_](?:[ .\-_*~'][^\W\d_]){2,}(?![^\W_]))"  # letters set apart
                    r"|(?<!\S)(?=\S*[^\W\d_])(?=\S*(?:[0-9@$!|+(<€£¡]|([^\W\d_])\1\1|[^\W_][.\-_*~'][^\W_]))\S+")
_WORD = re.compile(r"[^\W\d_]+")


def trigram_costs(docs: DataFrame, text: str = "text") -> np.ndarray:
    """-log P(class | two before) as a float32 cube of fixed size, with counts over all texts."""
    size, blocks = _CLASSES**3, 16
    width = size // blocks

    def count(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            for _, _, data, at in slices(column(batch, text)):
                c = np.concatenate((_CLASS[data], [0, 0]))
                c[at[1:-1]] = 0  # a text begins anew: its first character counts as a boundary
                total += np.bincount((c[:-2] << 12) | (c[1:-1] << 6) | c[2:], minlength=size)
        yield pa.record_batch([pa.array(range(blocks), pa.int32()),
                               pa.array([total[i * width : (i + 1) * width].tobytes() for i in range(blocks)], pa.binary())], ["block", "counts"])

    def add(key: tuple, rows: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), np.int64) for x in rows.column("counts"))
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})

    shape = "block int, counts binary"
    total = np.zeros(size, np.float64)
    for row in docs.select(text).mapInArrow(count, shape).groupBy("block").applyInArrow(add, shape).collect():  # 16 fixed blocks
        total[row["block"] * width : (row["block"] + 1) * width] = np.frombuffer(row["counts"], np.int64)
    tri = total.reshape(_CLASSES, _CLASSES, _CLASSES)
    bi = tri.sum(axis=0)
    uni = bi.sum(axis=0) + 1.0
    p1 = uni / uni.sum()
    p2 = (bi + 4 * p1[None, :]) / (bi.sum(axis=1, keepdims=True) + 4)
    return -np.log((tri + 4 * p2[None]) / (tri.sum(axis=2, keepdims=True) + 4)).astype(np.float32)


def _arcs(ch: str, before: str) -> list[tuple[str, float]]:
    """What a character may have been, with channel costs; '' when it was not typed as a letter."""
    out = [(ch, _STAND)]
    out += [(x, _IMITATE) for x in IMITATES.get(ch, "")]
    if ch in SEPARATORS:
        out.append(("", _SKIP))
    if ch == before and ch.isalpha():
        out.append(("", _REPEAT))
    return out


def restore(token: str, costs: np.ndarray) -> str:
    """The most likely lower-case text behind ``token``; a separator that stays becomes a blank.

    The decode is exact: a state is the pair of classes shown last, at most 4,096 of them, and
    all are kept.  A path is a chain of shown characters that paths share.  Wherever one state
    is left, what leads to it is settled and written out.
    """
    price_of = memoryview(costs.reshape(-1))
    here: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}
    settled, before = [], ""
    for ch in [*token.lower(), " "]:
        step: dict[int, tuple[float, tuple | None]] = {}
        arcs = [(" " if letter in SEPARATORS else letter, [int(_CLASS[byte]) for byte in (" " if letter in SEPARATORS else letter).encode()], price)
                if letter else ("", (), price) for letter, price in _arcs(ch, before)]
        for state, (cost, path) in here.items():
            for shown, classes, price in arcs:
                now, to = cost + price, state
                for c in classes:
                    now += price_of[to << 6 | c]
                    to = (to << 6 | c) & 4095
                old = step.get(to)
                if old is None or now < old[0]:
                    step[to] = (now, (path, shown) if shown else path)
        if len(step) == 1:
            (to, (_, path)), = step.items()
            settled.append(_written(path))
            step[to] = (0.0, None)
        here, before = step, ch
    _, path = min(here.values(), key=lambda x: x[0])
    return ("".join(settled) + _written(path)).strip()


def _written(path: tuple | None) -> str:
    out = []
    while path is not None:
        path, shown = path
        out.append(shown)
    return "".join(reversed(out))


class Restorer:
    """Restores whole texts; remembers the hidden words of a task, up to ``room`` characters."""

    def __init__(self, costs: np.ndarray, room: int = 4_000_000):
        self.costs, self.room, self.known, self.held = costs, room, {}, 0

    def _one(self, match: re.Match) -> str:
        token = match.group(0)
        got = self.known.get(token)
        if got is None:
            got = restore(token, self.costs)
            self.held += len(token) + len(got)
            if self.held > self.room:
                self.known.clear()
                self.held = len(token) + len(got)
            self.known[token] = got
        return got

    def words(self, text: str) -> tuple[set[str], set[str]]:
        """Distinct lower-case words of the text as it stands and as restored, and what was restored."""
        out = set(_WORD.findall(text.lower()))
        shown = {self._one(match) for match in {m.group(0): m for m in _HIDES.finditer(text)}.values()}
        for restored in shown:
            out.update(_WORD.findall(restored))
        return out, shown


def features(word: str) -> list[int]:
    """Buckets of a word: itself, then its beginnings, longest first."""
    raw = [word + "$", *(word[:k] for k in reversed(PREFIXES) if k <= len(word))]
    return [zlib.crc32(x.encode()) % FEATURES for x in raw]


def weigh(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> dict[int, list[float]]:
    """Evidence by level of each telling bucket, from the numbers of toxic and clean texts that have it.

    It is the lower end of the log-odds, so a feature seen seldom says little, and what says
    little is dropped.  A level inherits what the level below it says.
    """
    found = np.flatnonzero(toxic[0] >= SUPPORT)
    t, c = np.maximum(toxic[:, found], 0) + 0.5, np.maximum(clean[:, found], 0) + 1.0
    w = np.log(t / c) + math.log((n_clean + 1) / (n_toxic + 1)) - DOUBT * np.sqrt(1 / t + 1 / c)
    w = np.where((toxic[:, found] >= SUPPORT) & (w >= WEAKEST), w, 0.0)
    w = np.maximum.accumulate(w, axis=0)
    return {int(f): w[:, i].tolist() for i, f in enumerate(found) if w[-1, i] > 0}


def text_evidence(words: set[str], weights: dict[int, list[float]], keys: dict[str, int | None], known: np.ndarray) -> float:
    """Sum over the strongest words.

    The most specific known feature speaks for a word: a harmless word that begins like a
    telling one is cleared by its own beginning.  ``keys`` remembers it, up to a bound.
    """
    if len(keys) > 100_000:
        keys.clear()
    count: dict[int, int] = {}
    for word in words:
        if word in keys:
            f = keys[word]
        else:
            f = next((f for f in features(word) if known[f]), None)
            f = keys[word] = f if f in weights else None
        if f is not None:
            count[f] = count.get(f, 0) + 1
    each = [weights[f][min(n, LEVELS) - 1] for f, n in count.items() for _ in range(min(n, STRONGEST))]
    return sum(sorted(each, reverse=True)[:STRONGEST])


def held_out(doc_id: str | Column) -> Column:
    """Rows kept from training: crc32 of the id as text leaves 1 when divided by 3."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _with_look(train: DataFrame, text: str) -> DataFrame:
    """``train`` with _look: a digest of three minima over the three-word shingles, alike for near copies."""

    def run(batches):
        for batch in batches:
            looks = []
            for row, words in word_sets(column(batch, text), 3):
                minima = [int(mix(words ^ np.uint64(seed)).min()) for seed in (11, 222, 3333)] if len(words) else [0] * 3
                looks.append(zlib.crc32(repr(minima).encode()) << 32 | zlib.adler32(repr(minima).encode()))
            yield pa.record_batch([*batch.columns, pa.array([x - (1 << 63) for x in looks], pa.int64())], [*batch.schema.names, "_look"])

    return train.mapInArrow(run, StructType(list(train.schema)).add("_look", "long"))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", limit: int = TRAIN_ROWS) -> dict:
    """The model: trigram costs over all of ``docs``, evidence and calibration from ``labels``.

    Labelled rows with a null label or id are passed over, as are rows held out.  If an id has
    several labels, the highest counts.  Without a toxic and a clean row nothing is evidence
    and every score is next to 0.
    """
    spark = docs.sparkSession
    costs = trigram_costs(docs, text)
    marks = labels.where("doc_id is not null and toxic is not null").where(~held_out("doc_id")).groupBy("doc_id").agg(F.max("toxic").alias("_label"))
    count = marks.count()
    share = min(1.0, limit / max(1, count))
    chosen = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    train = docs.select("doc_id", text).join(F.broadcast(chosen), "doc_id")  # about ``limit`` ids, whatever the input
    # Copies of one text would make all its words telling: near copies count once for each label, by the least of them.
    least = F.min_by(text, F.struct("doc_id", text)).alias(text)
    train = stored(_with_look(train, text).groupBy("_look", "_label").agg(least).drop("_look"), "toxic-train")
    shared = spark.sparkContext.broadcast(costs)
    blocks = 64
    width = 2 * LEVELS * FEATURES // blocks

    def gather(batches):
        made = Restorer(shared.value)
        total = np.zeros((2, LEVELS, FEATURES), np.int32)
        seen = np.zeros(2, np.int64)
        for batch in batches:
            for value, label in zip(column(batch, text).to_pylist(), batch.column("_label").to_pylist()):
                count = Counter(f for w in made.words(value)[0] for f in features(w))
                at = np.fromiter(count.keys(), np.int64, len(count))
                n = np.fromiter(count.values(), np.int64, len(count))
                for level in range(LEVELS):
                    total[int(label > 0), level, at[n > level]] += 1
                seen[int(label > 0)] += 1
        flat = total.reshape(blocks, width)
        yield pa.record_batch([
            pa.array(range(blocks), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in flat], pa.binary()),
            pa.array([int(seen[0])] * blocks, pa.int64()), pa.array([int(seen[1])] * blocks, pa.int64())], ["block", "counts", "clean", "toxic"])

    def add(key: tuple, rows: pa.Table) -> pa.Table:
        total = np.zeros(width, np.int32)
        for x in rows.column("counts"):
            total += np.frombuffer(zlib.decompress(x.as_py()), np.int32)
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary()),
                         "clean": pa.array([sum(rows.column("clean").to_pylist())], pa.int64()),
                         "toxic": pa.array([sum(rows.column("toxic").to_pylist())], pa.int64())})

    shape = "block int, counts binary, clean long, toxic long"
    total = np.zeros((blocks, width), np.int32)
    n = [0, 0]
    for row in train.mapInArrow(gather, shape).groupBy("block").applyInArrow(add, shape).collect():  # 64 blocks of a fixed table
        total[row["block"]] = np.frombuffer(zlib.decompress(row["counts"]), np.int32)
        n = [row["clean"], row["toxic"]]
    clean, toxic = total.reshape(2, LEVELS, FEATURES)
    weights, known = weigh(toxic, clean, n[1], n[0]), toxic[0] + clean[0] >= KNOWN
    # For calibration a text's own label is taken out of the counts first.
    without = spark.sparkContext.broadcast((weigh(toxic, clean - 1, n[1], n[0]), weigh(toxic - 1, clean, n[1], n[0]), known))

    def sums(batches):
        made, keys = Restorer(shared.value), ({}, {})
        for batch in batches:
            marks = [int(m > 0) for m in batch.column("_label").to_pylist()]
            out = [text_evidence(made.words(v)[0], without.value[m], keys[m], without.value[2]) for v, m in zip(column(batch, text).to_pylist(), marks)]
            yield pa.record_batch([pa.array([min(int(x * 4), 200) for x in out], pa.int32()), pa.array(marks, pa.int32())], ["bin", "label"])

    table = np.zeros((201, 2))
    for row in train.mapInArrow(sums, "bin int, label int").groupBy("bin", "label").count().collect():  # at most 402 rows
        table[row["bin"], row["label"]] = row["count"]
    return {"costs": costs, "weights": weights, "known": known, "curve": _calibrate(table)}


def _calibrate(table: np.ndarray) -> tuple[float, float]:
    """(slope, offset) of a logistic curve over evidence, by Newton steps with a weak prior."""
    x = (np.arange(len(table)) + 0.5) / 4
    both = table.sum(axis=1)
    if not both.sum() or not table[:, 1].sum():
        return 0.0, -30.0
    design = np.stack([x, np.ones_like(x)], axis=1)
    start = np.array([0.5, -3.0])

    def loss(w: np.ndarray) -> float:
        z = design @ w
        return float((both * np.logaddexp(0, z) - table[:, 1] * z).sum() + 0.01 * ((w - start) ** 2).sum())

    w = start.copy()
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        grad = design.T @ (both * p - table[:, 1]) + 0.02 * (w - start)
        hess = design.T @ (design * (both * p * (1 - p))[:, None]) + 0.02 * np.eye(2)
        move, size = np.linalg.solve(hess, grad), 1.0
        while size > 1e-6 and loss(w - size * move) > loss(w):  # never uphill
            size /= 2
        w = w - size * move
        if np.abs(size * move).max() < 1e-9 or size <= 1e-6:
            break
    return float(max(w[0], 0.0)), float(w[1])


def score(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """``docs`` with toxicity (double, 0 to 1) and restored (the hidden words made readable).

    Null and empty texts have no evidence and get the score of none.  Columns of these names
    are replaced; others pass through.
    """
    base = docs.drop("toxicity", "restored")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        made, keys = Restorer(shared.value["costs"]), {}
        weights, (slope, offset) = shared.value["weights"], shared.value["curve"]
        for batch in batches:
            scores, shown = [], []
            for value in column(batch, text).to_pylist():
                found, restored = made.words(value)
                x = slope * text_evidence(found, weights, keys, shared.value["known"]) + offset
                scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, x)))))
                shown.append(sorted(restored - {""}))
            yield pa.record_batch([*batch.columns, pa.array(scores, pa.float64()), pa.array(shown, pa.list_(pa.string()))],
                                  [*batch.schema.names, "toxicity", "restored"])

    shape = StructType([*base.schema, *StructType.fromDDL("toxicity double, restored array<string>")])
    return base.mapInArrow(run, shape)
