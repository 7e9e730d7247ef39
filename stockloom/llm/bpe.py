"""Byte-level BPE by a global shuffle of distinct words.

The text is dealt into chunks of bounded size.  Each chunk cuts its texts into pre-tokens and
sends every pre-token it holds once, packed by hash bucket.  A bucket meets the blocks of all
chunks and runs the merges once for each distinct word.  The ids travel back to the chunk,
which walks its texts again and puts them together by position.  Decoding joins every id with
the token-byte table.  Only the rank table (a file of fixed size) is broadcast; a word that
occurs everywhere is one entry in one block of each chunk, so no word makes a task large.
"""

from __future__ import annotations

import base64
import hashlib
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import column, parts, text_bytes

#: Bytes of text in a chunk, and hash buckets of words for each chunk.
CHUNK_BYTES = 16 << 20
BUCKETS_PER_CHUNK = 0.5


def load_ranks(path: str) -> dict[bytes, int]:
    """The rank file: base64 of the token's bytes, a blank, its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def word_encoder(ranks: dict[bytes, int]):
    """Ids of one pre-token; the pattern takes the whole word, so nothing is cut again."""
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def _pack(items: list[bytes]) -> bytes:
    lengths = np.fromiter(map(len, items), np.uint32, len(items))
    return zstandard.ZstdCompressor(level=3).compress(np.uint32(len(items)).tobytes() + lengths.tobytes() + b"".join(items))


def _unpack(block: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(block)
    n = int(np.frombuffer(raw, np.uint32, 1)[0])
    ends = np.cumsum(np.frombuffer(raw, np.uint32, n, 4), dtype=np.int64) + 4 + 4 * n
    starts = np.concatenate(([4 + 4 * n], ends[:-1])) if n else ends
    return [raw[s:e] for s, e in zip(starts.tolist(), ends.tolist())]


def _vocabulary(tokens, buckets: int) -> dict[int, list[str]]:
    """The distinct pre-tokens by bucket, sorted, so that any later walk gets the same order."""
    seen: set[str] = set()
    for own in tokens:
        seen.update(own)
    out: dict[int, list[str]] = {}
    for word in sorted(seen):
        out.setdefault(zlib.crc32(word.encode()) % buckets, []).append(word)
    return out


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", keep_ids: bool = True) -> DataFrame:
    """``docs`` with n_tokens, ids_sha256, decoded_sha256 and (on request) token_ids.

    token_ids holds the ids as little-endian unsigned 32-bit integers.  Null text is read as
    empty: no ids, and the digests of no bytes.  Rows may repeat, keys may be null; each row is
    encoded by itself.  Columns of these names in ``docs`` are replaced; others pass through.
    """
    import regex

    spark = docs.sparkSession
    made = ["n_tokens", "ids_sha256", "decoded_sha256", "token_ids", "_chunk", "_bucket", "_block", "_spread"]
    kept = docs.drop(*[c for c in made if c != text])
    chunks = max(1, -(-text_bytes(docs, text) // CHUNK_BYTES))
    buckets = max(1, int(chunks * BUCKETS_PER_CHUNK))
    ranks = load_ranks(ranks_path)
    shared = spark.sparkContext.broadcast(ranks)
    find = regex.compile(pattern)

    # Equal rows get different places in the scan, so repeats spread over the chunks.
    dealt = (kept.withColumn("_spread", F.monotonically_increasing_id())
             .withColumn("_chunk", F.pmod(F.xxhash64("_spread"), F.lit(chunks)).cast("int")).drop("_spread")
             .repartition(max(parts(spark), min(chunks, 4 * parts(spark))), "_chunk"))

    def cut_words(table: pa.Table) -> pa.Table:
        batch = table.combine_chunks().to_batches()[0]
        words = _vocabulary(map(find.findall, column(batch, text).to_pylist()), buckets)
        return pa.table({"_chunk": pa.array([batch.column("_chunk")[0].as_py()] * len(words), pa.int32()),
                         "_bucket": pa.array(list(words), pa.int32()),
                         "_block": pa.array([_pack([w.encode() for w in v]) for v in words.values()], pa.binary())})

    def encode_blocks(batches):
        encoder, known = None, {}
        for batch in batches:
            encoder = encoder or word_encoder(shared.value)
            out = []
            for block in batch.column("_block"):
                ids = []
                for word in _unpack(block.as_py()):
                    got = known.get(word)
                    if got is None:
                        known[word] = got = np.array(encoder(word.decode()), "<u4").tobytes()
                    ids.append(got)
                out.append(_pack(ids))
            yield pa.record_batch([batch.column("_chunk"), batch.column("_bucket"), pa.array(out, pa.binary())],
                                  ["_chunk", "_bucket", "_block"])

    names = kept.columns

    def reassemble(table: pa.Table, blocks: pa.Table) -> pa.Table:
        batch = table.combine_chunks().to_batches()[0]
        # Every occurrence is the one string that stands for its word, so the lists stay small.
        one: dict[str, str] = {}
        tokens = [[one.setdefault(w, w) for w in find.findall(value)] for value in column(batch, text).to_pylist()]
        words = _vocabulary([one], buckets)
        ids_of: dict[str, bytes] = {}
        for bucket, block in zip(blocks.column("_bucket").to_pylist(), blocks.column("_block").to_pylist()):
            ids_of.update(zip(words[bucket], _unpack(block), strict=True))
        table_bytes: dict[int, bytes] = {rank: token for token, rank in shared.value.items()}
        n, ids_sha, text_sha, raw = [], [], [], []
        for own in tokens:
            ids = b"".join(map(ids_of.__getitem__, own))
            n.append(len(ids) // 4)
            ids_sha.append(hashlib.sha256(ids).hexdigest())
            decoded = b"".join(map(table_bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))
            text_sha.append(hashlib.sha256(decoded).hexdigest())
            raw.append(ids if keep_ids else None)
        columns = {c: batch.column(c) for c in names}
        columns |= {"n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids_sha, pa.string()),
                    "decoded_sha256": pa.array(text_sha, pa.string())}
        if keep_ids:
            columns["token_ids"] = pa.array(raw, pa.binary())
        return pa.table(columns)

    packed = "_chunk int, _bucket int, _block binary"
    # Both walks take the same columns, so Spark shuffles the texts once and reads them twice.
    words = dealt.groupBy("_chunk").applyInArrow(cut_words, packed)
    back = words.repartition(max(parts(spark), min(buckets, 4 * parts(spark))), "_bucket").mapInArrow(encode_blocks, packed)
    schema = StructType(list(kept.schema)).add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    if keep_ids:
        schema = schema.add("token_ids", "binary")
    return dealt.groupBy("_chunk").cogroup(back.groupBy("_chunk")).applyInArrow(reassemble, schema)


def decode(ids: DataFrame, ranks_path: str, column_name: str = "token_ids") -> DataFrame:
    """``ids`` with decoded (binary): the bytes of every id joined; null ids give no bytes.

    The token-byte table is a broadcast array of fixed size.  An id outside it is an error.
    """
    shared = ids.sparkSession.sparkContext.broadcast({r: t for t, r in load_ranks(ranks_path).items()})
    base = ids.drop("decoded")

    def run(batches):
        for batch in batches:
            out = [b"".join(shared.value[i] for i in np.frombuffer(x or b"", "<u4").tolist())
                   for x in batch.column(column_name).to_pylist()]
            yield pa.record_batch([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, "decoded"])

    return base.mapInArrow(run, StructType(list(base.schema)).add("decoded", "binary"))
