"""Document fingerprints: one-permutation MinHash with optimal densification, packed low bits.

A shingle hash falls into one of ``BINS`` bins by its high bits; a bin keeps its least hash.
An empty bin takes the value of the first full bin of its own fixed random probe sequence.
Only ``BITS`` low-order bits of each bin are stored.  Two unrelated bins then agree by chance
with probability 2**-BITS, which :func:`likeness` takes out again.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column, parts, text_bytes, word_sets

WIDTH = 5
BINS, BITS = 512, 4
#: Bytes of text in a run of neighbouring documents.
RUN_BYTES = 16 << 20

_U = np.uint64
_PROBE = np.argsort(np.random.default_rng(10).random((BINS, BINS)), axis=1).astype(np.int16)


def bins_of(hashes: np.ndarray) -> np.ndarray | None:
    """Low bits of every bin for sorted distinct hashes; None for an empty set."""
    if not len(hashes):
        return None
    at = (hashes >> _U(64 - BINS.bit_length() + 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    full = np.zeros(BINS, bool)
    full[at[first]] = True
    out = np.zeros(BINS, np.uint8)
    out[at[first]] = (hashes[first] & _U((1 << BITS) - 1)).astype(np.uint8)
    empty = np.flatnonzero(~full)
    for k in range(BINS):
        if not len(empty):
            break
        if k == 8 and len(first) < BINS // 4:  # few full bins: look the whole sequences up at once
            out[empty] = out[_PROBE[empty, full[_PROBE[empty]].argmax(axis=1)]]
            break
        source = _PROBE[empty, k]
        hit = full[source]
        out[empty[hit]] = out[source[hit]]
        empty = empty[~hit]
    return out


def pack(bins: np.ndarray | None) -> str:
    """Two bins a byte, as lowercase hex; the empty set is the empty string."""
    return "" if bins is None else (bins[0::2] << np.uint8(4) | bins[1::2]).tobytes().hex()


def likeness(a: np.ndarray | None, b: np.ndarray | None) -> float:
    """Estimated Jaccard similarity of the two sets, 0 to 1; two empty sets are alike."""
    if a is None or b is None:
        return float(a is None and b is None)
    chance = 2.0**-BITS
    return min(1.0, max(0.0, (float((a == b).mean()) - chance) / (1 - chance)))


def _prints(texts: pa.Array, width: int) -> list[np.ndarray | None]:
    return [bins_of(s) for _, s in word_sets(texts, width)]


def fingerprints(docs: DataFrame, width: int = WIDTH, text: str = "text") -> DataFrame:
    """``docs`` with fingerprint (string).  Null and empty text, and text without words, give ''."""
    from pyspark.sql.types import StructType

    base = docs.drop("fingerprint")

    def run(batches):
        for batch in batches:
            out = [pack(x) for x in _prints(column(batch, text), width)]
            yield pa.record_batch([*batch.columns, pa.array(out, pa.string())], [*batch.schema.names, "fingerprint"])

    return base.mapInArrow(run, StructType(list(base.schema)).add("fingerprint", "string"))


def edit_check(docs: DataFrame, width: int = WIDTH, text: str = "text") -> DataFrame:
    """Fingerprint of every text and of its edited text, and their likeness.

    The edited text has the last half of the code points (rounded down) replaced by as many of
    the next document's first ones, or all it has.  Next is by descending doc_id, null last,
    ties by descending text; after the last comes the first, and a lone document is its own
    next.  Null text is read as empty.  Columns: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next.  An empty table gives an empty table.

    The ids are cut into runs at approximate quantiles, each run is sorted and streamed, and
    the first row of a run follows the run before as a guard; no text is joined.
    """
    base = docs.select("doc_id", F.coalesce(text, F.lit("")).alias("text"))
    runs = min(max(1, -(-text_bytes(base, "text") // RUN_BYTES)), 1000)
    cuts = sorted(set(base.agg(F.percentile_approx("doc_id", [i / runs for i in range(1, runs)], 10 * runs).alias("c")).first()["c"] or [])) if runs > 1 else []
    over = F.array([F.lit(c).cast("long") for c in cuts]) if cuts else F.array().cast("array<long>")
    # Run 0 holds the largest ids; rows without an id come last.
    run = F.when(F.col("doc_id").isNull(), F.lit(len(cuts) + 1)).otherwise(F.size(F.filter(over, lambda c: c >= F.col("doc_id"))))
    dealt = base.withColumn("run", run.cast("int"))
    heads = dealt.groupBy("run").agg(F.max(F.struct("doc_id", "text")).alias("head"))
    whole = Window.orderBy("run")  # one row for each run
    follow = heads.select("run", F.coalesce(F.lead("head").over(whole), F.first("head").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("head"))
    guards = follow.select("run", "head.doc_id", "head.text", F.lit(1).alias("guard"))
    rows = (dealt.select("run", "doc_id", "text", F.lit(0).alias("guard")).unionByName(guards)
            .repartition(max(parts(docs.sparkSession), len(cuts) + 1), "run")
            .sortWithinPartitions("run", "guard", F.desc_nulls_last("doc_id"), F.desc("text")))

    def stream(batches):
        held = None  # the last row seen: run, id, text, bins
        for batch in batches:
            texts = column(batch, "text")
            now = list(zip(batch.column("run").to_pylist(), batch.column("doc_id").to_pylist(), texts.to_pylist(), _prints(texts, width),
                           batch.column("guard").to_pylist()))
            line = ([held] if held else []) + now
            pairs = [(x, y) for x, y in zip(line, line[1:]) if x[0] == y[0] and not x[4]]
            edited = [x[2][: len(x[2]) - len(x[2]) // 2] + y[2][: len(x[2]) // 2] for x, y in pairs]
            prints = _prints(pa.array(edited, pa.string()), width)
            yield pa.record_batch([
                pa.array([x[1] for x, _ in pairs], pa.int64()), pa.array([len(x[2]) for x, _ in pairs], pa.int64()),
                pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
                pa.array([pack(x[3]) for x, _ in pairs], pa.string()), pa.array([pack(p) for p in prints], pa.string()),
                pa.array([likeness(x[3], p) for (x, _), p in zip(pairs, prints)], pa.float64()),
                pa.array([likeness(x[3], y[3]) for x, y in pairs], pa.float64())],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
            held = line[-1]

    return rows.mapInArrow(stream, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
