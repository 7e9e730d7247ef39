"""Line dedup by an exact set-similarity join.

A line is the set of its words.  Lines with equal sets are one class.  Words are put in one
global order, rarest first, by a table of counts of fixed size; two sets of Jaccard t or more
then share a word among the first |x| - ceil(t|x|) + 1 of each.  Classes meet on those prefix
words and are pruned by length, by position and by parity bitmaps (the bits in which two
bitmaps differ bound the symmetric difference from below), none of which loses a match.
What is left only joins classes into clusters, by as few links as connect them, so rows follow
the classes and not their pairs.  Within a cluster, dealt into blocks if it is large, full sets
are compared and each class counts the earlier ones that match.  A line goes if one does.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import bitmap, column, components, hash_words, may_hold, mix, parts, slices, stored

THRESHOLD = 80
#: Counts that decide the order of words; a word falls into one of these buckets by its hash.
ORDER_BUCKETS = 1 << 18
#: Rows of a group on one prefix word up to which all its pairs are made at once, and pairs made at once.
GROUP, PAIRS = 4096, 1 << 18
#: Most 64-bit words in a parity bitmap.
PARITY = 4
#: Classes and words of one block of a cluster; shared words counted at once.
BLOCK, BLOCK_WORDS, COLUMNS = 1024, 1 << 18, 2048
#: Rows that follow each other in the table and are shuffled as one, as a power of two.
RUN_BITS = 9

_U = np.uint64


def _rarity(docs: DataFrame, text: str) -> np.ndarray:
    """Logarithmic count (0 to 255) of every bucket of words over all texts: 256 KB whatever the input."""
    width = ORDER_BUCKETS // 64

    def count(batches):
        total = np.zeros(ORDER_BUCKETS, np.int64)
        for batch in batches:
            for _, _, data, at in slices(column(batch, text)):
                _, words = hash_words(data, at)
                total += np.bincount((words >> _U(46)).astype(np.int64), minlength=ORDER_BUCKETS)
        yield pa.record_batch([pa.array(range(64), pa.int32()),
                               pa.array([total[i * width : (i + 1) * width].tobytes() for i in range(64)], pa.binary())],
                              ["block", "counts"])

    def add(key: tuple, rows: pa.Table) -> pa.Table:
        total = np.zeros(width, np.int64)
        for counts in rows.column("counts"):
            total += np.frombuffer(counts.as_py(), np.int64)
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})

    blocks = docs.select(text).mapInArrow(count, "block int, counts binary").groupBy("block").applyInArrow(add, "block int, counts binary")
    total = np.zeros(ORDER_BUCKETS, np.int64)
    for row in blocks.collect():  # 64 blocks of a table of fixed size
        total[row["block"] * width : (row["block"] + 1) * width] = np.frombuffer(row["counts"], np.int64)
    return np.minimum(255, np.log2(total + 1) * 8).astype(np.uint8)


def _line_words(data: np.ndarray, at: np.ndarray, order: np.ndarray):
    """Distinct words of every line, rarest first: (row of each line, number in its row, line bounds, hashes)."""
    breaks = np.flatnonzero(data == 10) + 1
    begins = np.concatenate((at[:-1], breaks))
    rows = np.concatenate((np.arange(len(at) - 1), np.searchsorted(at, breaks - 1, "right") - 1))
    place = np.lexsort((begins, rows))
    begins, rows = begins[place], rows[place]
    first = np.searchsorted(rows, np.arange(len(at) - 1))
    number = np.arange(len(rows)) - first[rows]
    starts, words = hash_words(data, at)
    # Empty rows share a start with the next row: among equal starts the last line owns the words.
    line = np.searchsorted(begins, starts, "right") - 1
    rank = order[(words >> _U(46)).astype(np.int64)]
    if len(begins) < 1 << 22:
        key = (line.astype(np.uint64) << _U(42)) | (rank.astype(np.uint64) << _U(34)) | (words >> _U(30))
        by = np.argsort(key)  # equal keys are equal words
    else:
        by = np.lexsort((words, rank, line))
    line, words = line[by], words[by]
    new = np.ones(len(words), bool)
    new[1:] = (words[1:] != words[:-1]) | (line[1:] != line[:-1])
    line, words = line[new], words[new]
    return rows, number, np.searchsorted(line, np.arange(len(begins) + 1)), words


def _digests(words: np.ndarray) -> bytes:
    """40 bits of every word hash: a pair of lines of 100 words mistakes one word in 10**8 pairs."""
    return words.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 3:].tobytes()


def _whole_groups(batches, keys: list[str], rows: int, shift: int = 0):
    """(table, starts of its groups): runs of rows sorted by ``keys`` less their low ``shift`` bits, cut only between groups.

    A table holds ``rows`` rows or more, but for the last; a larger group stays in one.
    """
    held, count, limit = [], 0, rows

    def starts(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, bool)
        new[:1] = True
        for key in keys:
            values = table.column(key).to_numpy() >> shift
            new[1:] |= values[1:] != values[:-1]
        return np.flatnonzero(new)

    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count >= limit:
            table = pa.Table.from_batches(held).combine_chunks()
            begin = starts(table)
            cut = int(begin[-1])
            if cut:
                yield table.slice(0, cut), begin[:-1]
            held, count = table.slice(cut).to_batches(), count - cut
            limit = max(rows, 2 * count)
    if count:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, starts(table)


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of every node to the least of its component in the graph with edges ``a``-``b``."""
    ids, flat = np.unique(np.concatenate((a, b)), return_inverse=True)
    u, v = flat[: len(a)], flat[len(a) :]
    root = np.arange(len(ids))
    while len(u):
        u, v = root[u], root[v]
        apart = u != v
        u, v = u[apart], v[apart]
        np.minimum.at(root, np.maximum(u, v), np.minimum(u, v))
        while (up := root[root]).tobytes() != root.tobytes():
            root = up
    moved = np.flatnonzero(root != np.arange(len(ids)))
    return ids[moved], ids[root[moved]]


def _parity_words(n: np.ndarray) -> np.ndarray:
    """64-bit words in the parity bitmap of a set: one of 64 bits says little of sets of more than 60 words."""
    return np.where(n <= 32, 1, np.where(n <= 96, 2, PARITY))


def _candidates(n: np.ndarray, pos: np.ndarray, bits: list[np.ndarray], starts: np.ndarray, percent: int):
    """Pairs of indices that connect what length, parity and position leave, within groups sorted by ``n``."""
    left, width = n - pos, _parity_words(n)
    # A wider bitmap folds to a narrower one.
    folds = {1: [bits[0] ^ bits[1] ^ bits[2] ^ bits[3]], 2: [bits[0] ^ bits[2], bits[1] ^ bits[3]], 4: bits}

    def alike(x, y):
        total = n[x] + n[y]
        most = (100 - percent) * total // (100 + percent)
        ok = (100 + percent) * np.minimum(left[x], left[y]) >= percent * total
        for words in (1, 2, 4):
            at = np.flatnonzero(ok)
            at = at[np.minimum(width[x[at]], width[y[at]]) >= words]
            ok[at] = sum(np.bitwise_count(b[x[at]] ^ b[y[at]]).astype(np.int64) for b in folds[words]) <= most[at]
        return ok

    size = np.diff(np.append(starts, len(n)))
    group = np.repeat(np.arange(len(starts)), size)
    # All pairs of small groups at once: each row with those after it up to the greatest length that fits.
    reach = np.searchsorted((group << 40) | n, (group << 40) | (100 * n // percent), "right")
    mates = np.where(size[group] <= GROUP, reach - np.arange(len(n)) - 1, 0)
    ends = np.cumsum(mates)
    # No longer set fits, so this many bits may differ at most; what passes is looked at closely.
    bound = np.minimum((100 - percent) * (n + 100 * n // percent) // (100 + percent), 64).astype(np.uint8)
    i = 0
    while i < len(n) and ends[-1] > (done := ends[i - 1] if i else 0):
        j = max(i + 1, int(np.searchsorted(ends, done + PAIRS, "right")))
        times = mates[i:j]
        y = np.arange(done, ends[j - 1]) + np.repeat(np.arange(i, j) + 1 - ends[i:j] + times, times)
        near = np.flatnonzero(np.bitwise_count(folds[1][0][y] ^ np.repeat(folds[1][0][i:j], times)) <= np.repeat(bound[i:j], times))
        x, y = i + np.searchsorted(ends[i:j], done + near, "right"), y[near]
        good = alike(x, y)
        yield x[good], y[good]
        i = j
    # In a large group a row that is reached already is not compared again.
    for g in np.flatnonzero(size > GROUP).tolist():
        rest = np.arange(starts[g], starts[g] + size[g])
        while len(rest):
            queue, rest = [int(rest[0])], rest[1:]
            sizes = n[rest]
            while queue and len(rest):
                x = queue.pop()
                lo, hi = np.searchsorted(sizes, _needed(n[x], percent)), np.searchsorted(sizes, 100 * n[x] // percent, "right")
                hit = lo + np.flatnonzero(alike(np.full(hi - lo, x), rest[lo:hi]))
                if len(hit):
                    yield np.full(len(hit), x), rest[hit]
                    queue.extend(rest[hit].tolist())
                    rest, sizes = np.delete(rest, hit), np.delete(sizes, hit)


def _shared(words: np.ndarray, member: np.ndarray, members: int) -> np.ndarray:
    """Words that each two of the members share, from the words and their members."""
    _, col, uses = np.unique(words, return_inverse=True, return_counts=True)
    twice = uses > 1
    keep = twice[col]
    member, col = member[keep], (np.cumsum(twice) - 1)[col[keep]]
    out = np.zeros((members, members), np.float32)  # exact up to 2**24 words of a line
    for c in range(0, int(twice.sum()), COLUMNS):
        part = (col >= c) & (col < c + COLUMNS)
        has = np.zeros((members, int(col[part].max()) - c + 1), np.float32)
        has[member[part], col[part] - c] = 1
        out += has @ has.T
    return out.astype(np.int64)


def _needed(n, percent: int):
    """The least overlap of a set of ``n`` with any set at ``percent`` or more."""
    return -(-percent * n // 100)


def _packed(batch: pa.RecordBatch) -> bytes:
    """The rows as one compressed Arrow stream, about half the size of rows that Spark shuffles one by one."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(rows: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(rows) as stream:
        return stream.read_next_batch()


def matches(docs: DataFrame, percent: int = THRESHOLD, text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lines, firsts, links) of ``docs`` with columns _row (long), _id and ``text``.

    lines: every line with words, its class and place; firsts: the earliest line of each
    class by (_id null last, _row, line); links: the firsts (_row, line) that earlier classes
    match, and how many (links); the rows of one line are to be added up.
    """
    spark = docs.sparkSession
    order = spark.sparkContext.broadcast(_rarity(docs, text))
    parity = [f"bits{k}" for k in range(PARITY)]

    def sets(batches):
        for batch in batches:
            ids = np.array(batch.column("_row").to_numpy(zero_copy_only=False))
            for i, j, data, at in slices(column(batch, text)):
                rows, number, bounds, words = _line_words(data, at, order.value)
                n = np.diff(bounds)
                has = n > 0
                begin = bounds[:-1][has]
                n = n[has]
                if not len(n):
                    continue
                k1 = np.add.reduceat(mix(words), begin)
                k2 = np.add.reduceat(mix(words ^ _U(0x5851F42D4C957F2D)), begin)
                place = mix(words + _U(7))
                bit, word = _U(1) << (place & _U(63)), (place >> _U(6)) & (np.repeat(_parity_words(n), n) - 1).astype(_U)
                bits = [pa.array(np.bitwise_xor.reduceat(np.where(word == _U(k), bit, _U(0)), begin).view(np.int64)) for k in range(PARITY)]
                size = np.where(_needed(n + 1, percent) > n, np.where(_needed(n, percent) >= n, 0, 1), 1)
                size = size * (n - _needed(n, percent) + 1)
                ends = np.cumsum(size)
                at_word = np.arange(ends[-1]) - np.repeat(ends - size, size) + np.repeat(begin, size)
                token = (words[at_word] & _U(0xFFFFFFFF)).astype(np.uint32).view(np.int32)
                prefix = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(token))
                yield pa.record_batch([batch.column("_id").take(pa.array(i + rows[has])), pa.array(ids[i:j][rows[has]]), pa.array(number[has].astype(np.int32)), pa.array(k1.view(np.int64)),
                                       pa.array(k2.view(np.int64)), pa.array(n.astype(np.int32)), *bits, prefix],
                                      ["_id", "_row", "line", "k1", "k2", "n", *parity, "prefix"])

    rest = StructType.fromDDL(f"_row long, line int, k1 long, k2 long, n int, {' long, '.join(parity)} long, prefix array<int>")
    shape = StructType([docs.schema["_id"], *rest])
    lines = stored(docs.select("_id", "_row", text).mapInArrow(sets, shape), "lines")
    earliest = F.struct(F.col("_id").isNull().alias("none"), "_id", "_row", "line", "n", *parity, "prefix")
    firsts = stored(lines.groupBy("k1", "k2").agg(F.min(earliest).alias("f")).select("k1", "k2", "f._row", "f.line", "f.n", *[f"f.{c}" for c in parity], "f.prefix"), "firsts")
    # One long for the word and the size keeps a posting small, and one column is sorted without comparing
    # rows.  A class goes by k1 alone: two that share it by chance are in one cluster, which loses nothing.
    post = firsts.select(F.posexplode("prefix").alias("pos", "token"), "k1", "n", *parity) \
        .select(F.expr("(cast(token as long) << 32) | cast(n as long)").alias("tn"), "k1", "pos", *parity)

    def connect(batches):
        for table, starts in _whole_groups(batches, ["tn"], 1 << 17, 32):
            many = np.diff(np.append(starts, table.num_rows)) > 1
            if not many.any():
                continue
            rows = np.repeat(many, np.diff(np.append(starts, table.num_rows)))
            tn, k1, pos, *bits = (table.column(c).to_numpy()[rows] for c in ("tn", "k1", "pos", *parity))
            token = tn >> 32
            begin = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
            a, b, found = k1[:0], k1[:0], []
            for x, y in _candidates(tn & 0xFFFFFFFF, pos, [w.view(np.uint64) for w in bits], begin, percent):
                found.append((k1[x], k1[y]))
                if sum(len(side) for side, _ in found) > PAIRS:
                    a, b = _forest(*(np.concatenate(side) for side in zip((a, b), *found)))
                    found = []
            a, b = _forest(*(np.concatenate(side) for side in zip((a, b), *found)))
            yield pa.record_batch([pa.array(a), pa.array(b)], ["a", "b"])

    near = post.repartition(parts(spark), F.shiftright("tn", 32)).sortWithinPartitions("tn").mapInArrow(connect, "a long, b long")
    member = components(near).select(F.col("node").alias("k1"), F.col("component").alias("cluster"))
    wanted = stored(firsts.select("_row", "line", "k1", "n").join(member, "k1"), "line-wanted")
    rows_wanted = spark.sparkContext.broadcast(bitmap(wanted.select(F.xxhash64("_row").alias("h")), "h"))
    lines_wanted = spark.sparkContext.broadcast(bitmap(wanted, "k1"))

    def full(batches):
        for batch in batches:
            hit = may_hold(rows_wanted.value, batch.column("_h").to_numpy(zero_copy_only=False))
            batch = batch.filter(pa.array(hit))
            ids = batch.column("_row").to_numpy(zero_copy_only=False)
            row_at, line_at, out = [], [], []
            for i, j, data, at in slices(column(batch, text)):
                rows, number, bounds, words = _line_words(data, at, order.value)
                has = np.flatnonzero(np.diff(bounds))
                if len(has):
                    k1 = np.add.reduceat(mix(words), bounds[:-1][has])
                    for k in has[may_hold(lines_wanted.value, k1)].tolist():
                        row_at.append(i + int(rows[k]))
                        line_at.append(int(number[k]))
                        out.append(_digests(words[bounds[k] : bounds[k + 1]]))
            yield pa.record_batch([batch.column("_id").take(pa.array(row_at, pa.int64())), pa.array(ids[row_at] if row_at else [], pa.int64()),
                                   pa.array(line_at, pa.int32()), pa.array(out, pa.binary())], ["_id", "_row", "line", "words"])

    shape = StructType([docs.schema["_id"], *StructType.fromDDL("_row long, line int, words binary")])
    # The bitmaps spare a shuffle of the texts; what they let through by chance is dropped by the joins.
    whole = docs.select("_id", "_row", F.xxhash64("_row").alias("_h"), text).mapInArrow(full, shape)
    blocks = wanted.groupBy("cluster").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_WORDS)).cast("int").alias("blocks")).where("blocks > 1")
    dealt = wanted.join(blocks, "cluster", "left").select("_row", "line", "cluster", F.coalesce("blocks", F.lit(1)).alias("blocks")) \
        .withColumn("side", F.pmod(F.xxhash64("_row", "line"), "blocks").cast("int"))
    # Each two blocks of a cluster are one group, its lines in order.
    whole = whole.join(dealt, ["_row", "line"]).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))) \
        .select("cluster", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "_id", "_row", "line", "words") \
        .repartition(parts(spark), "cluster", "i", "j") \
        .sortWithinPartitions("cluster", "i", "j", F.col("_id").asc_nulls_last(), "_row", "line") \
        .select("cluster", "i", "j", "side", "_row", "line", "words")

    def count(batches):
        for table, starts in _whole_groups(batches, ["cluster", "i", "j"], 2048):
            words = table.column("words").to_pylist()
            size = np.array([len(x) // 5 for x in words], np.int64)
            raw = np.zeros((int(size.sum()), 8), np.uint8)
            raw[:, :5] = np.frombuffer(b"".join(words), np.uint8).reshape(-1, 5)
            digest, at = raw.reshape(-1).view("<u8"), np.concatenate(([0], np.cumsum(size)))
            owner = np.repeat(np.arange(len(words)), size)
            i, j, side = (table.column(c).to_numpy() for c in ("i", "j", "side"))
            links = np.zeros(len(words), np.int64)
            for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(words)]):
                shared = _shared(digest[at[s] : at[e]], owner[at[s] : at[e]] - s, e - s)
                good = (100 + percent) * shared >= percent * (size[s:e, None] + size[s:e])
                if i[s] != j[s]:
                    good &= side[s:e, None] != side[s:e]
                links[s:e] = np.triu(good, 1).sum(axis=0)
            some = pa.array(np.flatnonzero(links))
            yield pa.record_batch([table.column("_row").combine_chunks().take(some), table.column("line").combine_chunks().take(some), pa.array(links).take(some)],
                                  ["_row", "line", "links"])

    return lines, firsts, stored(whole.mapInArrow(count, "_row long, line int, links long"), "line-links")


def dedup_lines(docs: DataFrame, percent: int = THRESHOLD, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` without the lines that an earlier line matches, and lines_in, lines_out, line_links (longs).

    Lines end at LF.  They are ordered by (doc_id, null last; then the table's own order; line
    number).  A line without words never matches and stays.  Null text stays null, with no
    lines; empty text is one blank line.  A document that loses every line stays, with empty
    text.  Repeated rows are documents of their own: the later one loses its lines.
    line_links counts the earlier classes with another set that match lines of the document
    which are first of their class.  Columns of these names are replaced; others pass through.
    ``docs`` must be a stored table: it is scanned more than once and its rows are told apart
    by scan order.
    """
    spark = docs.sparkSession
    made = ["lines_in", "lines_out", "line_links", "_row", "_id", "_gone", "_links", "_h"]
    base = docs.drop(*made).withColumn("_row", F.monotonically_increasing_id()).withColumn("_id", F.col(doc_id))
    lines, firsts, links = matches(base.select("_row", "_id", text), percent, text)
    repeats = lines.select("_row", "line", "k1", "k2").join(
        firsts.select("k1", "k2", F.col("_row").alias("first_row"), F.col("line").alias("first_line")), ["k1", "k2"]) \
        .where("_row <> first_row or line <> first_line").select("_row", "line", F.lit(0).alias("links"))
    found = links.groupBy("_row", "line").agg(F.sum("links").alias("links"))
    gone = stored(repeats.union(found).groupBy("_row").agg(F.collect_list("line").alias("_gone"), F.sum("links").alias("_links")), "line-gone")

    names, counts = base.drop("_row", "_id").columns, ["lines_in", "lines_out", "line_links"]
    shape = StructType(list(base.drop("_row", "_id").schema))
    for name in counts:
        shape = shape.add(name, "long")

    # Texts that lose no line are not shuffled: the bitmap shows which rows cannot be in ``gone``.
    losing = spark.sparkContext.broadcast(bitmap(gone.select(F.xxhash64("_row").alias("h")), "h"))

    def rest(batches):
        for batch in batches:
            batch = batch.filter(pa.array(~may_hold(losing.value, batch.column("_h").to_numpy(zero_copy_only=False))))
            number = pc.fill_null(pc.add(pc.count_substring(batch.column(text), "\n").cast(pa.int64()), 1), 0)
            yield pa.record_batch([*(batch.column(c) for c in names), number, number, pa.array(np.zeros(batch.num_rows, np.int64))],
                                  [*names, *counts])

    def pack(batches):
        for batch in batches:
            batch = batch.filter(pa.array(may_hold(losing.value, batch.column("_h").to_numpy(zero_copy_only=False)))).select([*names, "_row"])
            run = batch.column("_row").to_numpy(zero_copy_only=False) >> RUN_BITS
            for rows in np.split(np.arange(len(run)), np.flatnonzero(run[1:] != run[:-1]) + 1):
                if len(rows):
                    yield pa.record_batch([pa.array(run[rows[:1]]), pa.array([_packed(batch.slice(int(rows[0]), len(rows)))], pa.binary())], ["run", "rows"])

    def rewrite(batches):
        now, lost = None, {}
        for batch in batches:
            for at in range(batch.num_rows):
                run, rows, row, lines_of, links_of = (batch.column(c)[at].as_py() for c in ("run", "rows", "_row", "_gone", "_links"))
                if run != now:
                    now, lost = run, {}
                if rows is None:
                    lost[row] = set(lines_of), links_of
                    continue
                held = _unpacked(rows)
                out, before, after, links = [], [], [], []
                for value, row in zip(held.column(text).to_pylist(), held.column("_row").to_pylist()):
                    drop, many = lost.get(row, ((), 0))
                    parts_of = [] if value is None else value.split("\n")
                    kept = [x for i, x in enumerate(parts_of) if i not in drop] if drop else parts_of
                    out.append(None if value is None else "\n".join(kept))
                    before.append(len(parts_of))
                    after.append(len(kept))
                    links.append(many)
                columns = [pa.array(out, pa.string()) if c == text else held.column(c) for c in names]
                yield pa.record_batch([*columns, *(pa.array(x, pa.int64()) for x in (before, after, links))], [*names, *counts])

    hashed = base.drop("_id").withColumn("_h", F.xxhash64("_row"))
    packed = hashed.mapInArrow(pack, "run long, rows binary")
    lost = gone.select(F.shiftright("_row", RUN_BITS).alias("run"), "_row", "_gone", "_links")
    # What a run loses comes before its rows.
    touched = packed.unionByName(lost, allowMissingColumns=True).repartition(parts(spark), "run") \
        .sortWithinPartitions("run", F.col("rows").isNotNull()).mapInArrow(rewrite, shape)
    return touched.unionByName(hashed.mapInArrow(rest, shape))
