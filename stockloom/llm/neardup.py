"""MinHash near-dedup with sequential Bayesian verification.

Texts with equal shingle sets are one class (named by a 64-bit digest of the set); only
classes are compared.  Classes that agree in a band of the signature share a bucket.  Each
bucket compares its members with its leader, so candidates grow with the members and not with
their square; what is alike becomes a cluster, and a class is in one cluster however many
buckets it shares.  Within a cluster, pairs of signatures are compared batch by batch and
dropped as soon as the posterior chance of a similarity at the threshold falls below
``miss``.  Survivors are verified on their full sets; only links that connect leave a group.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, components, mix, parts, stored, word_sets

WIDTH, PERCENT = 2, 80
#: A pair at 0.8 misses all bands with probability (1 - 0.8**6)**56, about 4e-8.
ROWS, BANDS = 6, 56
#: Hashes compared at a time, and the chance of losing a true pair that pruning accepts.
BATCH, MISS = 48, 1e-9

_U = np.uint64
_draw = np.random.default_rng(8)
_FACTOR = _draw.integers(0, 1 << 31, ROWS * BANDS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_TWIST = _draw.integers(0, 1 << 32, ROWS * BANDS, dtype=np.uint32)


def signature(hashes: np.ndarray) -> np.ndarray:
    """Low 16 bits of the minimum of every hash function over a set of 64-bit hashes."""
    best = np.full(len(_FACTOR), 0xFFFFFFFF, np.uint32)
    low = (hashes >> _U(32)).astype(np.uint32)
    for i in range(0, len(low), 1024):
        v = low[None, i : i + 1024] ^ _TWIST[:, None]
        np.multiply(v, _FACTOR[:, None], out=v)
        np.minimum(best, v.min(axis=1), out=best)
    return ((best >> np.uint32(8)) & np.uint32(0xFFFF)).astype(np.uint16)


def least_matches(percent: int = PERCENT, miss: float = MISS, batch: int = BATCH) -> np.ndarray:
    """For each number of batches, the fewest agreeing hashes at which a pair lives on.

    After m of n hashes agree, the posterior from a uniform prior is Beta(m+1, n-m+1), whose
    mass above t is P(Binomial(n+1, t) <= m).
    """
    t = percent / 100
    out = []
    for n in range(batch, ROWS * BANDS + 1, batch):
        mass, m = 0.0, -1
        while mass < miss:
            m += 1
            mass += math.exp(math.lgamma(n + 2) - math.lgamma(m + 1) - math.lgamma(n + 2 - m) + m * math.log(t) + (n + 1 - m) * math.log(1 - t))
        out.append(m)
    return np.array(out)


def survivors(a: np.ndarray, b: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Indices of the rows of two signature matrices that no batch rules out."""
    alive = np.arange(len(a))
    agree = np.zeros(len(a), np.int64)
    for k, bound in enumerate(least):
        cols = slice(k * BATCH, (k + 1) * BATCH)
        agree = agree + (a[alive, cols] == b[alive, cols]).sum(axis=1)
        good = agree >= bound
        alive, agree = alive[good], agree[good]
    return alive


def _matrix(col: pa.Array) -> np.ndarray:
    if not len(col):
        return np.zeros((0, len(_FACTOR)), np.uint16)
    return np.frombuffer(b"".join(x.as_py() for x in col), np.uint16).reshape(-1, len(_FACTOR))


def sign(docs: DataFrame, width: int = WIDTH, text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, cls, sig): size, digest and signature of every shingle set."""

    def run(batches):
        for batch in batches:
            n, cls, sig = [], [], []
            for _, s in word_sets(column(batch, text), width):
                n.append(len(s))
                with np.errstate(over="ignore"):
                    cls.append(int((mix(np.array([mix(s).sum(dtype=np.uint64) + _U(len(s))], np.uint64))).view(np.int64)[0]))
                sig.append(signature(s).tobytes() if len(s) else None)
            yield pa.record_batch([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), pa.array(sig, pa.binary())],
                                  ["doc_id", "n_shingles", "cls", "sig"])

    return docs.select("doc_id", text).mapInArrow(run, "doc_id long, n_shingles long, cls long, sig binary")


def buckets(signed: DataFrame) -> DataFrame:
    """(bucket, cls) for every band."""
    place = np.arange(BANDS, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)

    def run(batches):
        for batch in batches:
            m = _matrix(batch.column("sig")).reshape(-1, BANDS, ROWS).astype(np.uint64)
            key = np.repeat(place[None, :], len(m), axis=0)
            for r in range(ROWS):
                key = mix(key + m[:, :, r] + _U(r + 1))
            cls = np.repeat(batch.column("cls").to_numpy(zero_copy_only=False), BANDS)
            yield pa.record_batch([pa.array(key.reshape(-1).view(np.int64)), pa.array(cls, pa.int64())], ["bucket", "cls"])

    return signed.select("cls", "sig").mapInArrow(run, "bucket long, cls long")


#: Estimated likeness to a leader from which a class joins the leader's cluster (NEAR), and from
#: which it is done with its bucket (MATE).  Jaccard distance obeys the triangle inequality: if one
#: of two texts at 0.8 is at 0.65 to the leader, the other is at 0.45 or more, so both are near.
NEAR, MATE = 0.35, 0.65
#: Rounds of leaders; members of a cluster in one block.
LEADERS, BLOCK = 3, 1024


def clusters(hits: DataFrame, signed: DataFrame) -> DataFrame:
    """(cls, cluster): classes that a bucket brings together, so that no pair at 0.8 is torn apart.

    In every round each bucket compares its members with its leader.  What is near joins the
    leader's cluster; what is no mate of it stays, unless all that stay are in one cluster.
    A round gives at most one row for each member.  What is open after the last round is
    joined to one cluster whatever its likeness, so rounds are few and nothing is lost.
    """
    spark = hits.sparkSession
    sig = stored(signed.select("cls", "sig").join(hits.select("cls").distinct(), "cls", "left_semi").dropDuplicates(["cls"]), "near-sigs")
    sig = sig.repartition(parts(spark), "cls")

    def compare(batches):
        for batch in batches:
            a, b = _matrix(batch.column("sig_a")), _matrix(batch.column("sig_b"))
            yield pa.record_batch([batch.column("leader"), batch.column("cls"), pa.array((a == b).mean(axis=1).astype(np.float32) if len(a) else [], pa.float32())],
                                  ["leader", "cls", "alike"])

    links = None
    rest = hits.withColumn("label", F.col("cls"))
    for _ in range(LEADERS):
        # The leader is of the least label, so a stray of the last round leads soon or meets its like.
        lead = rest.groupBy("bucket").agg(F.min(F.struct("label", "cls")).alias("first"), F.min("label").alias("lo"), F.max("label").alias("hi")) \
            .where("lo <> hi").select("bucket", F.col("first.cls").alias("leader"))
        pairs = stored(rest.join(lead, "bucket").where("cls <> leader"), "near-led")
        found = stored(pairs.select("leader", "cls").distinct()
                       .join(sig.select(F.col("cls").alias("leader"), F.col("sig").alias("sig_a")), "leader")
                       .join(sig.select("cls", F.col("sig").alias("sig_b")), "cls")
                       .select("leader", "cls", "sig_a", "sig_b").mapInArrow(compare, "leader long, cls long, alike float"), "near-found")
        near = found.where(F.col("alike") >= NEAR).select(F.col("leader").alias("a"), F.col("cls").alias("b"))
        links = near if links is None else links.union(near)
        rest = stored(pairs.join(found, ["leader", "cls"]).where(F.col("alike") < MATE)
                      .select("bucket", "cls", F.when(F.col("alike") >= NEAR, F.col("leader")).otherwise(F.col("label")).alias("label")), "near-left")
    last = rest.groupBy("bucket").agg(F.min("cls").alias("a"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("bucket", "a")
    links = links.union(rest.join(last, "bucket").where("cls <> a").select("a", F.col("cls").alias("b")))
    return components(links).select(F.col("node").alias("cls"), F.col("component").alias("cluster"))


def verified(member: DataFrame, signed: DataFrame, docs: DataFrame, width: int, percent: int, miss: float, text: str) -> DataFrame:
    """Links (a, b) that join all classes of a cluster which exact similarity connects.

    A cluster is dealt into blocks, and each pair of blocks is one group.  Signatures are
    compared batch by batch; the class with most survivors is verified first against all of
    its own, and a pair that is already connected in the group needs no look at the sets.
    """
    spark = docs.sparkSession
    least = least_matches(percent, miss)
    one = signed.join(member.select("cls"), "cls", "left_semi").groupBy("cls").agg(F.min(F.struct("doc_id", "n_shingles")).alias("o")) \
        .select("cls", F.col("o.doc_id").alias("doc_id"), F.col("o.n_shingles").alias("n"))

    def sets(batches):
        for batch in batches:
            out = [(len(s), s.tobytes(), signature(s).tobytes() if len(s) else b"") for _, s in word_sets(column(batch, text), width)]
            yield pa.record_batch([batch.column("cls"), batch.column("n"), pa.array([x[0] for x in out], pa.int64()),
                                   pa.array([x[1] for x in out], pa.binary()), pa.array([x[2] for x in out], pa.binary())], ["cls", "n", "size", "words", "sig"])

    # A doc_id can stand for several texts; the set must be of the class's own size.
    whole = docs.select("doc_id", text).join(one, "doc_id").select("cls", "n", text) \
        .mapInArrow(sets, "cls long, n long, size long, words binary, sig binary").where("n = size").select("cls", "words", "sig")
    blocks = member.groupBy("cluster").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    rows = (member.join(blocks, "cluster").withColumn("side", F.pmod(F.xxhash64("cls"), "blocks").cast("int"))
            .join(whole, "cls").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .select("cluster", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "cls", "words", "sig"))

    def compare(key: tuple, group: pa.Table) -> pa.Table:
        sig, side = _matrix(group.column("sig").combine_chunks()), group.column("side").to_numpy()
        cls, words = group.column("cls").to_numpy(), group.column("words").combine_chunks()
        within = key[1].as_py() == key[2].as_py()
        size = np.array([len(w.as_py()) // 8 for w in words])
        mates = []
        for x in range(len(cls)):
            fits = (100 * np.minimum(size, size[x]) >= percent * np.maximum(size, size[x])) & (cls != cls[x])
            mate = np.flatnonzero(fits if within else fits & (side != side[x]))
            mates.append(mate[survivors(np.broadcast_to(sig[x], (len(mate), sig.shape[1])), sig[mate], least)])
        root = list(range(len(cls)))

        def top(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        a, b, done = [], [], np.zeros(len(cls), bool)
        for x in sorted(range(len(cls)), key=lambda x: -len(mates[x])):
            own = None
            for y in mates[x].tolist():
                if done[y] or top(x) == top(y):
                    continue
                own = np.frombuffer(words[x].as_py(), np.uint64) if own is None else own
                shared = len(np.intersect1d(own, np.frombuffer(words[y].as_py(), np.uint64), assume_unique=True))
                if 100 * shared >= percent * (int(size[x]) + int(size[y]) - shared):
                    root[top(y)] = top(x)
                    a.append(int(cls[x]))
                    b.append(int(cls[y]))
            done[x] = True
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.groupBy("cluster", "i", "j").applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, miss: float = MISS, text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id long, ``text``).

    A set holds the distinct ``width``-word shingles; fewer words give the whole sequence as
    one; no words give the empty set, linked with nothing.  component_id is the least doc_id
    reachable, kept is doc_id = component_id.  Equal sets are linked.  Rows with one doc_id are one document: all of
    them get its component.  A row without doc_id takes no part: component_id null, kept true.
    An empty table gives an empty table; other columns of ``docs`` are ignored.
    """
    base = docs.select("doc_id", text)
    signed = stored(sign(base, width, text), "near-signed")
    live = signed.where("doc_id is not null and n_shingles > 0")
    bands = buckets(live)
    shared = bands.groupBy("bucket").agg(F.min("cls").alias("least"), F.max("cls").alias("most")).where("least <> most").select("bucket")
    hits = stored(bands.join(shared, "bucket").distinct(), "near-hits")
    member = stored(clusters(hits, live), "near-clusters")
    links = stored(verified(member, live, base, width, percent, miss, text), "near-links")
    low = live.groupBy("doc_id").agg(F.min("cls").alias("a"))
    same = live.select("doc_id", "cls").join(low, "doc_id").where("cls <> a").select("a", F.col("cls").alias("b")).distinct()
    classes = live.groupBy("cls").agg(F.min("doc_id").alias("rep"))
    named = components(links.union(same)).withColumnRenamed("node", "cls")
    least = named.join(classes, "cls").groupBy("component").agg(F.min("rep").alias("least"))
    facts = stored(classes.join(named.join(least, "component").select("cls", "least"), "cls", "left")
                   .select("cls", F.coalesce("least", "rep").alias("least")), "near-classes")
    # Empty sets take their own id.
    return (signed.select("doc_id", "n_shingles", F.when(F.expr("doc_id is not null and n_shingles > 0"), F.col("cls")).alias("cls"))
            .join(facts, "cls", "left")
            .select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"),
                    (F.col("doc_id").isNull() | (F.col("doc_id") == F.coalesce("least", "doc_id"))).alias("kept")))
