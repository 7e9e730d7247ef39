"""Approximate nearest neighbours by inner product over balanced posting lists.

Vectors are lifted to one length (a last component sqrt(M^2 - |x|^2)), so the largest inner
product is the least distance.  A bounded sample is cut into balanced clusters; their centres
are few and sit in memory with a neighbour graph.  A vector goes to the list of its nearest
centre and, near a boundary, to further lists within a distance ratio.  A query walks the
graph and searches the lists whose distance ratio to the nearest is small enough.

Equal vectors are one entry with their least ids, so copies do not fill a list.  Lists of
neighbouring centres share a shelf.  A shelf is dealt into blocks by size; a block meets the
queries of its shelf in runs of bounded size, and each query sees only the lists it chose.
A query's nearest shelves are searched first and give a bound on its last score; the others
send only what reaches it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import parts, stored

#: Vectors that the centres are fitted on, at most, and lists, at most.
SAMPLE, LISTS = 40_000, 2_048
#: Members of a list that the number of lists aims at in the sample, and the balance bound (times the mean).
LIST_SIZE, BALANCE = 128, 2.0
#: Lists a vector may go to, and the distance ratio up to which it does.
REPLICAS, CLOSURE = 2, 1.02
#: The distance ratio up to which a query searches a list; their number has no cap.
RATIO = 1.16
#: Links of a centre in the graph; the walk keeps this many centres for a vector, and all lists for a query.
DEGREE, BEAM = 16, 16
#: Neighbouring lists on one shelf, and a query's nearest shelves, which are searched before the others.
SHELF, FIRST = 16, 2
BLOCK, QUERY_BLOCK = 4_096, 1_024


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 6) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        label = np.argmin((centres**2).sum(1)[None] - 2 * x @ centres.T, axis=1)
        for i in range(k):
            if (label == i).any():
                centres[i] = x[label == i].mean(axis=0)
    return label


def fit_centres(sample: np.ndarray, lists: int, seed: int = 2) -> np.ndarray:
    """Centres of balanced clusters: what is larger than ``BALANCE`` times the mean is cut again,
    and splinters (under an eighth of the mean) are left to their neighbours.
    """
    if not len(sample):
        return np.zeros((0, sample.shape[1]))
    rng = np.random.default_rng(seed)
    most = max(2, int(BALANCE * len(sample) / max(1, lists)))
    work, done = [sample], []
    while work:
        part = work.pop()
        distinct = len(np.unique(part[: most + 1], axis=0)) > 1
        if len(part) <= most or not distinct:
            done.append((len(part), part.mean(axis=0)))
            continue
        k = int(min(16, max(2, round(len(part) / most * BALANCE)), len(part)))
        label = _kmeans(part.copy(), k, rng)
        pieces = [part[label == i] for i in range(k) if (label == i).any()]
        if len(pieces) == 1:
            half = rng.permutation(len(part))
            pieces = [part[half[: len(part) // 2]], part[half[len(part) // 2 :]]]
        work += pieces
    whole = [c for n, c in done if 8 * BALANCE * n >= most]
    return np.array(whole or [c for _, c in done])


def neighbour_graph(centres: np.ndarray, degree: int = DEGREE) -> np.ndarray:
    """Each centre's nearest ones, plus random far links so that the graph hangs together."""
    n = len(centres)
    d = (centres**2).sum(1)[:, None] + (centres**2).sum(1)[None] - 2 * centres @ centres.T
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1, kind="stable")[:, : min(degree, max(n - 1, 1))]
    far = np.random.default_rng(3).integers(0, n, (n, 4))
    return np.concatenate((near, far), axis=1)


def search_graph(x: np.ndarray, centres: np.ndarray, graph: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search for all rows of ``x`` at once: (centre ids, squared distances), nearest first."""
    n, m = len(x), len(centres)
    beam = min(beam, m)
    square = (centres**2).sum(1)
    entry = np.unique(np.linspace(0, m - 1, min(m, 32)).astype(int))
    seen = np.zeros((n, m), bool)
    seen[:, entry] = True
    ids = np.repeat(entry[None], n, axis=0)
    dist = square[ids] - 2 * x @ centres[entry].T
    opened = np.zeros(ids.shape, bool)
    rows = np.arange(n)[:, None]
    while True:
        rank = np.argsort(dist, axis=1, kind="stable")[:, :beam]
        ids, dist, opened = ids[rows, rank], dist[rows, rank], opened[rows, rank]
        todo = np.where(opened, np.inf, dist)
        pick = np.argsort(todo, axis=1, kind="stable")[:, :4]
        live = np.isfinite(todo[rows, pick])
        if not live.any():
            break
        opened[rows, pick] = True
        new = graph[ids[rows, pick]].reshape(n, -1)
        fresh = ~seen[rows, new] & np.repeat(live, graph.shape[1], axis=1)
        order = np.argsort(new, axis=1, kind="stable")
        new, fresh = new[rows, order], fresh[rows, order]
        fresh[:, 1:] &= ~((new[:, 1:] == new[:, :-1]) & fresh[:, :-1])
        seen[np.nonzero(fresh)[0], new[fresh]] = True
        value = np.where(fresh, square[new] - 2 * np.einsum("nd,nkd->nk", x, centres[new]), np.inf)
        ids, dist = np.concatenate((ids, new), axis=1), np.concatenate((dist, value), axis=1)
        opened = np.concatenate((opened, ~fresh), axis=1)
    return ids, np.maximum(dist + (x**2).sum(1)[:, None], 0)


def _stack(col, width: int) -> np.ndarray:
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(-1, width)


def _lists(x: np.ndarray, index, beam: int, ratio: float, sizes: np.ndarray | None = None, least: int = 0):
    """(row, list, is nearest) for the lists within ``ratio`` times the least distance of each row.

    A row that lies on a centre is treated as if it were a usual distance away from it.  With
    ``sizes`` a row also takes further lists until those hold ``least`` entries.
    """
    centres, graph, usual = index
    ids, dist = search_graph(x, centres, graph, beam=beam)
    near = np.sqrt(dist)
    keep = near <= near[:, :1] + (ratio - 1) * np.maximum(near[:, :1], usual)
    if sizes is not None:
        before = np.cumsum(sizes[ids], axis=1) - sizes[ids]
        keep |= before < least
    keep &= np.isfinite(dist)
    row, at = np.nonzero(keep)
    return row, ids[row, at], at == 0


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` candidates of largest inner product found.

    ``queries`` has the columns of ``vectors``.  A query is not its own candidate (same id).
    Ties go to the smaller id; fewer than k candidates give all of them.  Null vectors, zero
    vectors, vectors with null or non-finite components, of another length than the longest
    share of rows has, or without an id take no part.  Rows that repeat count once.  No usable
    vector gives no rows.  Other columns are ignored.
    """
    spark = vectors.sparkSession

    def usable(df: DataFrame) -> DataFrame:
        v = F.col(vector).cast("array<double>")
        fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))) & F.exists(v, lambda c: c != 0)
        return df.where(F.col(vec_id).isNotNull() & v.isNotNull()).select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).where(fine)

    every = usable(vectors)
    # The commonest length; one row for each length.
    sizes = every.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if sizes is None:
        return empty
    dim = sizes["n"]
    every = every.where(F.size("v") == dim)
    asked = usable(queries).where(F.size("v") == dim)

    # One entry for equal vectors, with the k + 1 least ids: first within salts, then over them.
    def classes(df: DataFrame, keep: int) -> DataFrame:
        salted = df.distinct().withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
        first = Window.partitionBy("v", "salt").orderBy("vec_id")
        least = salted.withColumn("r", F.row_number().over(first)).where(F.col("r") <= keep)
        return least.groupBy("v").agg(F.slice(F.array_sort(F.collect_list("vec_id")), 1, keep).alias("ids"))

    entries = stored(classes(every, k + 1).withColumn("entry", F.element_at("ids", 1)), "ann-entries")
    facts = entries.agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c)).alias("top")).first()
    share = min(1.0, SAMPLE / facts["n"])
    picked = entries.where(F.pmod(F.xxhash64("entry"), F.lit(1 << 30)) < int(share * (1 << 30))).select("v").limit(2 * SAMPLE).toPandas()
    sample = np.array(picked["v"].tolist(), np.float64).reshape(-1, dim)

    def lift(x: np.ndarray) -> np.ndarray:
        return np.concatenate((x, np.sqrt(np.maximum(facts["top"] - (x**2).sum(1), 0))[:, None]), axis=1)

    centres = fit_centres(lift(sample), int(min(LISTS, max(1, len(sample) // LIST_SIZE))))
    graph = neighbour_graph(centres)
    usual = float(np.median(np.sqrt(search_graph(lift(sample[:2048]), centres, graph)[1][:, 0])))
    index = spark.sparkContext.broadcast((centres, graph, usual))

    def post(batches):
        for batch in batches:
            if batch.num_rows:
                for i in range(0, batch.num_rows, 1024):
                    part = batch.slice(i, 1024)
                    row, at, first = _lists(lift(_stack(part.column("v"), dim)), index.value, BEAM, CLOSURE)
                    own = np.ones(len(row), bool)
                    own[REPLICAS:] = row[REPLICAS:] != row[:-REPLICAS]
                    row, at, first = row[own], at[own], first[own]
                    yield pa.record_batch([pa.array(at, pa.int32()), pa.array(first), part.column("entry").take(pa.array(row)), part.column("v").take(pa.array(row)),
                                           part.column("ids").take(pa.array(row))], ["list", "home", "entry", "v", "ids"])

    def ask(batches):
        for batch in batches:
            if batch.num_rows:
                for i in range(0, batch.num_rows, 1024):
                    part = batch.slice(i, 1024)
                    x = _stack(part.column("v"), dim)
                    # A query is lifted by 0: only its direction matters.  It is given the common length.
                    x = np.concatenate((x * np.sqrt(facts["top"] / (x**2).sum(1))[:, None], np.zeros((len(x), 1))), axis=1)
                    row, at, _ = _lists(x, index.value, len(centres), RATIO, held.value, k + 1)
                    order = np.lexsort((at, row))  # lists of a query come nearest first; ``order`` is their place in that
                    row, at = row[order], at[order]
                    new = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (at[1:] // SHELF != at[:-1] // SHELF))))
                    picked = pa.ListArray.from_arrays(pa.array(np.concatenate((new, [len(at)])), pa.int32()), pa.array(at % SHELF, pa.int32()))
                    # A query's shelves by the nearest of their lists.
                    nearest_list, of = np.minimum.reduceat(order, new), row[new]
                    by = np.lexsort((nearest_list, of))
                    rank = np.empty(len(of), np.int64)
                    rank[by] = np.arange(len(of)) - np.searchsorted(of, of)
                    yield pa.record_batch([pa.array(at[new] // SHELF, pa.int32()), part.column("query").take(pa.array(of)),
                                           part.column("v").take(pa.array(of)), picked, pa.array(rank < FIRST)], ["shelf", "query", "v", "lists", "early"])

    posted = stored(entries.mapInArrow(post, "list int, home boolean, entry long, v array<double>, ids array<long>"), "ann-lists")
    size = np.zeros(len(centres), np.int64)
    for row in posted.where("home").groupBy("list").count().collect():  # a row for each list
        size[row["list"]] = row["count"]
    held = spark.sparkContext.broadcast(size)
    question = stored(classes(asked, 1).select(F.element_at("ids", 1).alias("query"), "v"), "ann-queries")
    probes = stored(question.mapInArrow(ask, "shelf int, query long, v array<double>, lists array<int>, early boolean"), "ann-probes")
    shelved = posted.select(F.floor(F.col("list") / SHELF).cast("int").alias("shelf"), (F.col("list") % SHELF).alias("list"), "entry", "v")
    blocks = (shelved.groupBy("shelf").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("vb"))
              .join(probes.groupBy("shelf").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("qb")), "shelf"))
    left = (shelved.join(blocks, "shelf").withColumn("i", F.pmod(F.xxhash64("entry"), "vb").cast("int"))
            .withColumn("j", F.explode(F.sequence(F.lit(0), F.col("qb") - 1))).drop("vb", "qb"))

    def asking(rows: DataFrame) -> DataFrame:
        return (rows.join(blocks, "shelf").withColumn("j", F.pmod(F.xxhash64("query"), "qb").cast("int"))
                .withColumn("i", F.explode(F.sequence(F.lit(0), F.col("vb") - 1))).select("shelf", "i", "j", "query", "v", "lists", "least"))

    def scan(entries_: pa.Table, probes_: pa.Table) -> pa.Table:
        out = {"query": [], "entry": [], "score": []}
        if entries_.num_rows and probes_.num_rows:
            x = _stack(entries_.column("v").combine_chunks(), dim)
            q = _stack(probes_.column("v").combine_chunks(), dim)
            entry, query = entries_.column("entry").to_numpy(), probes_.column("query").to_numpy()
            place, picked = entries_.column("list").to_numpy(), probes_.column("lists").to_pylist()
            least = probes_.column("least").to_numpy()
            score = q @ x.T
            for r in range(len(q)):
                own = np.zeros(SHELF, bool)
                own[picked[r]] = True
                sees = np.flatnonzero(own[place])
                # A replicated entry stands here once.
                sees = sees[np.unique(entry[sees], return_index=True)[1]]
                top = min(k + 1, len(sees))
                if not top:
                    continue
                value = score[r, sees]
                # The k + 1 best entries, and those that tie with the last of them.
                edge = np.partition(value, len(sees) - top)[len(sees) - top]
                best = sees[value >= max(edge, least[r]) - 1e-9]
                best = best[np.lexsort((entry[best], -score[r, best]))][: top + 8]
                out["query"] += [int(query[r])] * len(best)
                out["entry"] += entry[best].tolist()
                out["score"] += [float(np.dot(q[r], x[b])) for b in best]
        return pa.table({"query": pa.array(out["query"], pa.int64()), "entry": pa.array(out["entry"], pa.int64()), "score": pa.array(out["score"], pa.float64())})

    best = Window.partitionBy("query").orderBy(F.desc("score"), "entry")

    def search(rows: DataFrame) -> DataFrame:
        return left.groupBy("shelf", "i", "j").cogroup(asking(rows).groupBy("shelf", "i", "j")).applyInArrow(scan, "query long, entry long, score double")

    def shortened(hits: DataFrame) -> DataFrame:
        # Scores of one pair agree in every list; a query has few rows for each shelf it searched.
        return hits.groupBy("query", "entry").agg(F.max("score").alias("score")).withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1)

    # The nearest shelves first: the score of the last of k + 1 entries found there is a bound that
    # the other shelves must reach, so they send few rows however many they are.
    early = stored(shortened(search(probes.where("early").withColumn("least", F.lit(float("-inf"))))), "ann-early")
    bound = early.where(F.col("r") == k + 1).select("query", F.col("score").alias("bound"))
    late = probes.where("not early").join(bound, "query", "left").withColumn("least", F.coalesce("bound", F.lit(float("-inf"))))
    short = stored(shortened(early.select("query", "entry", "score").union(search(late))), "ann-short")
    ids = short.join(entries.select("entry", "ids"), "entry").select("query", "score", F.explode("ids").alias("vec_id"))
    ranked = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    found = ids.withColumn("r", F.row_number().over(ranked)).where(F.col("r") <= k + 1).groupBy("query").agg(F.collect_list(F.struct("score", "vec_id")).alias("hits"))
    names = asked.distinct().join(question.withColumnRenamed("query", "q"), "v").select(F.col("vec_id").alias("query_id"), "q")
    mine = names.join(found, F.col("q") == F.col("query")).select("query_id", F.explode("hits").alias("h")).where("h.vec_id <> query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("h.score"), "h.vec_id")
    return (mine.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), F.col("h.vec_id").alias("vec_id"), F.col("h.score").alias("score")))
