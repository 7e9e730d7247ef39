"""What the operators of this package share: word hashing on Arrow buffers, stored tables, components.

A *word* is a run of bytes other than space, tab, LF, VT, FF and CR, with A-Z lower-cased.
Words are hashed inside the text buffer by prefix sums of a keyed polynomial modulo 2**64,
so no Python object is made per word; 64-bit hashes stand for words in set comparisons.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockloom.session import scratch_path, shuffle_partitions

#: Bytes of text hashed at once, and bytes of text taken together from an Arrow batch.
WINDOW = 1 << 18
SLICE = 1 << 19

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BYTE = np.random.default_rng(20240817).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BYTE[65:91] = _BYTE[97:123]
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        have = np.full(max(n, WINDOW + 1), base, np.uint64)
        have[0] = 1
        _powers[name] = have = np.cumprod(have, dtype=np.uint64)
    return have[:n]


def hash_words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words of ``data``; no word crosses a position in ``bounds``.

    The buffer is taken in windows that end between words, so memory follows the window
    and the longest word, not the text.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    solid = ~_SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    hashes = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        at = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, at + WINDOW, "right")))
        width = int(ends[j - 1] - at)
        sums = np.zeros(width + 1, np.uint64)
        np.cumsum(_BYTE[data[at : at + width]] * _power("up", _BASE, width), out=sums[1:])
        s, e = starts[i:j] - at, ends[i:j] - at
        hashes[i:j] = mix((sums[e] - sums[s]) * _power("down", _INVERSE, width)[s])
        i = j
    return starts, hashes


def word_ends(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Ends of the words that :func:`hash_words` finds."""
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    last = ~_SPACE[data]
    last[:-1] &= _SPACE[data[1:]] | edge[1:-1]
    return np.flatnonzero(last) + 1


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words within each group of words, and each group's bounds.

    A group of fewer words (but at least one) gives its whole sequence as one shingle.
    """
    counts = np.diff(bounds)
    sizes = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    out_bounds = np.concatenate(([0], np.cumsum(sizes)))
    group = np.repeat(np.arange(len(counts)), sizes)
    at = np.arange(out_bounds[-1]) - out_bounds[:-1][group] + bounds[:-1][group]
    h = np.zeros(len(at), np.uint64)
    for k in range(width):
        inside = at + k < bounds[1:][group]
        value = np.where(inside, words[np.minimum(at + k, max(len(words) - 1, 0))], _U(0)) if len(words) else h
        h = mix(h * _BASE + value + _U(k + 1))
    return h, out_bounds


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A text column with nulls read as empty, as one plain string array."""
    array = pc.fill_null(batch.column(name), "")
    return array.cast(pa.string()) if array.type != pa.string() else array


def slices(array: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of at most ``limit`` bytes (one row at least): (first, end, bytes, offsets)."""
    _, offsets, data = array.buffers()
    if not len(array):
        return
    at = np.frombuffer(offsets, np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(array):
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        yield i, j, raw[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def word_sets(array: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every row of a text column."""
    for i, j, data, at in slices(array):
        starts, words = hash_words(data, at)
        hashes, bounds = shingle_hashes(words, np.searchsorted(starts, at), width)
        for row in range(i, j):
            yield row, np.unique(hashes[bounds[row - i] : bounds[row - i + 1]])


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and go on from the written rows."""
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Words of 64 bits in a bitmap of hashes: 1 MB whatever the input.
BITMAP = 1 << 17


def bitmap(df: DataFrame, hashed: str) -> np.ndarray:
    """The bits that the hashes in a long column set.  A clear bit proves that a hash is absent."""
    h = F.col(hashed)
    rows = df.groupBy(F.shiftrightunsigned(h, 6).bitwiseAND(BITMAP - 1).cast("int").alias("w")) \
        .agg(F.bit_or(F.expr(f"shiftleft(1L, cast({hashed} & 63 as int))")).alias("b")).collect()  # at most BITMAP rows
    out = np.zeros(BITMAP, np.int64)
    for row in rows:
        out[row["w"]] = row["b"]
    return out


def may_hold(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each hash (int64 or uint64) finds its bit set."""
    h = hashes.astype(np.uint64, copy=False) if hashes.dtype == np.uint64 else hashes.view(np.uint64)
    return (bits.view(np.uint64)[((h >> _U(6)) & _U(BITMAP - 1)).astype(np.int64)] >> (h & _U(63))) & _U(1) == 1


def text_bytes(docs: DataFrame, text: str) -> int:
    """Total bytes of a text column; one scan of that column."""
    return docs.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0


def parts(spark: SparkSession, least: int = 1) -> int:
    return max(least, shuffle_partitions(spark))


def contract(links: DataFrame, turn: int = 0) -> tuple[DataFrame, DataFrame]:
    """(node, parent) with each node's first neighbour or itself, and the edges left between parents.

    First is the least id in turn 0 and the least of a hash that changes with the turn later, so
    that neither a star nor a chain in order of ids takes many turns.  A node and its parent are
    in one component; edges to a common parent become loops and go, so what is left follows the
    number of leaders and not of members.
    """
    ends = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def first(c: str):
        return F.struct(F.xxhash64(c, F.lit(turn)).alias("h") if turn else F.col(c).alias("h"), F.col(c).alias("id"))

    best = ends.groupBy(F.col("a").alias("node")).agg(F.min(first("b")).alias("near"))
    parent = stored(best.select("node", F.least("near", first("node"))["id"].alias("parent")), "parents")
    up = lambda side: parent.select(F.col("node").alias(side), F.col("parent").alias(f"p{side}"))
    moved = links.join(up("a"), "a").join(up("b"), "b").where("pa <> pb")
    return parent, stored(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "contracted")


def components(links: DataFrame, turns: int = 100) -> DataFrame:
    """(node, component) of the graph with edges ``a``-``b``; a component is named by its least node.

    Every turn contracts each node into one neighbour and goes on with the edges between what is
    left, so turns grow with the logarithm of a component's size and edges shrink from turn to
    turn.  Roots then come down again, one join of nodes a turn.
    """
    edges = stored(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    parents = []
    while not edges.isEmpty():
        if len(parents) == turns:
            raise RuntimeError("the components did not settle")
        parent, edges = contract(edges, len(parents))
        parents.append(parent)
    if not parents:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("component"))
    root = parents[-1]
    for parent in reversed(parents[:-1]):
        above = root.select(F.col("node").alias("parent"), F.col("parent").alias("far"))
        root = stored(parent.join(above, "parent", "left").select("node", F.coalesce("far", "parent").alias("parent")), "roots")
    least = root.groupBy("parent").agg(F.min("node").alias("component"))
    return root.join(least, "parent").select("node", "component")
