"""Product codes of vectors in exact integers, by value dictionaries of each dimension.

Components become integers ``floor(scale * x)``.  A vector is cut into equal parts and every
part is named by the nearest entry of its codebook, which integer k-means refines.

Distances are never computed vector by entry.  In a block of vectors every dimension gets a
dictionary of its distinct integers; the squared differences of each distinct integer to all
entries are tabulated once, and a part's distances are gathers from these tables by dictionary
code, added over the part's dimensions.  The sums of the next codebook are histograms of
(entry, dictionary code) times the dictionary.  A block is one Arrow batch, so dictionaries and
tables are bounded by its rows whatever the range of values.

A round is one scan without a shuffle of rows: a task hands on one count and one sum for each
(entry, dimension), and the driver gets ``entries * dimensions`` rows, which do not grow.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockloom.session import small_side

from .common import stored

#: The published setting: integers per unit, parts, entries of a codebook, rounds of refinement.
SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6


def _limit(width: int) -> int:
    """The largest component whose squared distances, summed over a vector, fit 64 bits."""
    return math.isqrt((1 << 61) // width) // 2


def integers(vectors: DataFrame, vector: str, scale: int, parts: int) -> tuple[DataFrame, int]:
    """The rows that take part, with ``_v`` (their integers) in place of ``vector``, and the length of a vector."""
    x = F.transform(F.col(vector), lambda c: c.cast("double") * F.lit(float(scale)))
    finite = F.forall("_v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = stored(vectors.withColumn("_v", x).drop(vector).where(F.col("_v").isNotNull() & finite), "finite")
    size = rows.groupBy(F.size("_v").alias("n")).count().where(f"n > 0 and n % {parts} = 0") \
        .orderBy(F.desc("count"), F.desc("n")).first()
    width = size["n"] if size else parts
    most = float(_limit(width))
    fits = (F.size("_v") == width) & F.forall("_v", lambda c: F.abs(c) <= F.lit(most))
    return stored(rows.where(fits).withColumn("_v", F.transform("_v", lambda c: F.floor(c).cast("long"))), "integers"), width


def _matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return np.asarray(batch.column("_v").flatten()).reshape(batch.num_rows, width)


def _assign(block: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray, list]:
    """(entry, squared distance) of each row and part, and each dimension's (dictionary, codes).

    ``books`` is parts x entries x dimensions of a part.
    """
    parts, _, wide = books.shape
    entry = np.empty((len(block), parts), np.int64)
    error = np.empty((len(block), parts), np.int64)
    words = [np.unique(block[:, d], return_inverse=True) for d in range(parts * wide)]
    for p in range(parts):
        distance = np.zeros((len(block), books.shape[1]), np.int64)
        for j in range(wide):
            values, codes = words[p * wide + j]
            table = np.square(values[:, None] - books[p, :, j][None])
            distance += table[codes]
        entry[:, p] = distance.argmin(1)  # the lower index of a tie
        error[:, p] = np.take_along_axis(distance, entry[:, p : p + 1], 1)[:, 0]
    return entry, error, words


def fit(rows: DataFrame, width: int, order: str, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (parts x entries x dimensions of a part) refined over every row of ``rows``.

    They start as the parts of the rows with the ``entries`` least ``order`` values (nulls last,
    ties by the vector); fewer rows make fewer entries.  An entry without parts stays.
    """
    first = rows.orderBy(F.asc_nulls_last(order), "_v").limit(entries).select("_v").collect()
    wide = width // parts
    books = np.array([r["_v"] for r in first], np.int64).reshape(len(first), parts, wide).transpose(1, 0, 2).copy()
    if not len(first):
        return books

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(books.shape, np.int64), np.zeros(books.shape, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            entry, _, words = _assign(_matrix(batch, width), books)
            for d, (values, codes) in enumerate(words):
                p, j = divmod(d, wide)
                seen = np.bincount(entry[:, p] * len(values) + codes, minlength=books.shape[1] * len(values)).reshape(-1, len(values))
                count[p, :, j] += seen.sum(1)
                total[p, :, j] += seen @ values
        at = np.flatnonzero(count.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(count.ravel()[at]), pa.array(total.ravel()[at])], ["at", "n", "total"])

    for _ in range(rounds):
        found = rows.select("_v").mapInArrow(sums, "at long, n long, total long").groupBy("at").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
        new = books.ravel().copy()
        for r in found.collect():  # entries * width rows at most
            new[r["at"]] = r["total"] // r["n"]
        books = new.reshape(books.shape)
    return books


def encode(rows: DataFrame, width: int, books: np.ndarray) -> DataFrame:
    """``rows`` with ``code`` (two hex digits a part) and ``error`` (squared distances summed) in place of ``_v``."""
    kept = [c for c in rows.columns if c != "_v"]

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            entry, error, _ = _assign(_matrix(batch, width), books)
            codes = entry.astype(np.uint8)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array([r.tobytes().hex() for r in codes]), pa.array(error.sum(1))],
                                             [*kept, "code", "error"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*kept).schema), "code string", "error long"])
    return rows.mapInArrow(name, schema)


def books_digest(books: np.ndarray) -> str:
    """Hash of all entries' decimal components by part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, order: str, vector: str, label: str, scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES,
             rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(order, label, code, error, label_error, codebooks_sha256) of every vector, and the codebooks.

    Left out are vectors that are null, hold null or non-finite components, have another length
    than most (the length must be a multiple of ``parts``; of lengths equally frequent the longer
    counts), or components so large that a squared distance would not fit 64 bits (64 dimensions
    at scale 4,096: beyond 23,170).  Repeated ids are vectors of their own.  ``label_error`` is the error summed over equal labels; null is a
    label.  Other columns do not matter.  An empty table gives no rows.  At most 256 entries.
    """
    if entries > 256:
        raise ValueError("a code has two hex digits a part")
    plain = vectors.select(F.col(order).alias("key"), F.col(label).alias("label"), F.col(vector).alias("vector"))
    rows, width = integers(plain, "vector", scale, parts)
    books = fit(rows, width, "key", parts, entries, rounds)
    coded = stored(encode(rows, width, books), "codes") if books.size else encode(rows.where("false"), width, np.zeros((parts, 1, width // parts), np.int64))
    spent = small_side(coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")))
    out = coded.join(spent, F.col("label").eqNullSafe(F.col("_label"))).select(
        F.col("key").alias(order), F.col("label").alias(label), "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))
    return out, books
