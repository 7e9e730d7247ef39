"""One thin query for each operator, over its whole table; ``QUERIES`` and ``ORACLES`` are merged by the entry file."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, chat, fingerprint, licenses, lines, merkle, mixing, neardup, private, quality, toxicity, vectorcodes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ranks_path() -> str:
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@query("op3_byte_bpe")
def byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Every whole text encoded and decoded: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return bpe.encode(docs, ranks_path(), public_tokenizers.PATTERN, keep_ids=False).drop("text")


@query("op1_line_dedup")
def line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the lines that an earlier line of the table matches."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return lines.dedup_lines(docs).select("doc_id", "lines_in", "lines_out", "line_links", F.sha2("text", 256).alias("text_sha256"),
                                          F.length("text").cast("long").alias("n_chars"))


@query("op5_mix_sources")
def mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Words that the mixture takes of every document."""
    documents, _ = mixing.mix(table(spark, folder, "documents").select("doc_id", "source", "text"))
    return documents.select("doc_id", "size", "source_size", "target", "taken")


_NEAR_SQL = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
 s AS (SELECT DISTINCT doc_id, ws[i] || ' ' || ws[i + 1] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws))) AS i FROM w) UNION SELECT doc_id, ws[1] FROM w WHERE len(ws) = 1),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
 e AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
 l AS (SELECT a, b FROM e JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
 r(doc_id, reach) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.reach)
 SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
 FROM (SELECT doc_id, min(reach) AS component_id FROM r GROUP BY 1) c LEFT JOIN n USING (doc_id)"""


@query("op8_minhash_near_dedup", _NEAR_SQL)
def minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate component of every document on two-word shingles."""
    found = neardup.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


@query("op10_fingerprints")
def fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint of every text and of its edited text, and their likeness."""
    return fingerprint.edit_check(table(spark, folder, "documents"))


@query("op6_toxicity")
def toxic_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every whole text, learnt from the labelled rows that are not held out."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, folder, "labels"))
    scored = toxicity.score(docs, model).drop("restored")
    return scored.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), F.col("toxicity").alias("score"),
                         F.when(F.col("toxicity") >= toxicity.TOXIC_FROM, 1).otherwise(0).alias("predicted"))


@query("op2_nearest_neighbours")
def nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20."""
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    return ann.nearest(vectors, vectors.where("vec_id % 20 = 0"))


@query("op4_quality_classifier")
def quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of every whole text from weak labels; no row of ``labels`` is read."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return quality.score(docs, quality.fit(docs)).drop("text")


@query("op7_license_scan")
def license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Licence of every document; its path is source / language / hundred of ids / id.

    The licence line of these texts stands last, so any line passes its licence on.
    """
    docs = table(spark, folder, "documents")
    place = F.concat_ws("/", F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-")), F.floor(F.col("doc_id") / 100), F.col("doc_id"))
    return licenses.scan(docs.select("doc_id", place.alias("path"), "text"), any_line=True)


_CHAT_SQL = """WITH t AS (SELECT c.*, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position FROM conversations c),
 u AS (SELECT t.*, EXISTS (SELECT 1 FROM conversations o WHERE o.conv_id = t.conv_id AND o.turn = t.turn + 1 AND o.role = 'assistant') AS answered,
   EXISTS (SELECT 1 FROM conversations o WHERE o.conv_id = t.conv_id AND o.turn = t.turn - 1 AND o.role = 'user') AS asked FROM t)
 SELECT conv_id, position, turn, CASE role WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' ELSE 'message' END AS kind,
  CASE role WHEN 'user' THEN 'c' || conv_id || '-' || turn WHEN 'assistant' THEN 'c' || conv_id || '-' || (turn - 1) END AS call_id,
  CASE role WHEN 'user' THEN CASE WHEN answered THEN 'ok' ELSE 'ok;open' END WHEN 'assistant' THEN CASE WHEN asked THEN 'linked' ELSE 'orphan' END ELSE 'ok' END AS status,
  CASE role WHEN 'user' THEN CASE WHEN turn % 4 = 0 THEN '{"arguments":{"limit":' || length(text) || ',"query":' || to_json(text) || '},"id":"c' || conv_id || '-' || turn || '","name":"search","type":"call"}'
     ELSE '{"arguments":{"strict":' || (length(text) % 2 = 0) || ',"text":' || to_json(text) || '},"id":"c' || conv_id || '-' || turn || '","name":"annotate","type":"call"}' END
   WHEN 'assistant' THEN '{"content":' || to_json(text) || ',"id":"c' || conv_id || '-' || (turn - 1) || '","type":"result"}'
   ELSE '{"content":' || to_json(text) || ',"role":' || to_json(role) || ',"type":"message"}' END AS json FROM u"""


@query("op9_chat_format", _CHAT_SQL)
def chat_format(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations as tool traffic: a user's turn is a call, the assistant's next turn its result.

    The call of an even user turn is a search, of another an annotation; its parent is the
    user's call before.  Turns of other roles are plain messages.
    """
    turns = table(spark, folder, "conversations")
    name = F.concat(F.lit("c"), F.col("conv_id"), F.lit("-"), F.col("turn"))
    args = F.when(F.col("turn") % 4 == 0, F.to_json(F.struct(F.col("text").alias("query"), F.length("text").alias("limit")))) \
        .otherwise(F.to_json(F.struct((F.length("text") % 2 == 0).alias("strict"), F.col("text").alias("text"))))
    calls = turns.where("role = 'user'").select(
        "conv_id", "turn", name.alias("call_id"), F.concat(F.lit("c"), F.col("conv_id"), F.lit("-"), F.col("turn") - 2).alias("parent_id"),
        F.when(F.col("turn") % 4 == 0, "search").otherwise("annotate").alias("name"), args.alias("arguments"))
    results = turns.where("role = 'assistant'").select(
        "conv_id", "turn", F.concat(F.lit("c"), F.col("conv_id"), F.lit("-"), F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    rest = turns.where("role is null or role not in ('user', 'assistant')").select("conv_id", "turn", "role", "text")
    return chat.format_calls(rest, calls, results)


_CRC_SQL = """list_reduce(list_prepend(4294967295, list_transform(range(1, length({0}) + 1), lambda i: ascii({0}[i])::BIGINT)),
   lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, (x & 1) * 3988292384)))"""
_FIELD_SQL = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}) || ':' || {0} END"
_LEAF_SQL = "sha256(" + " || ".join(_FIELD_SQL.format(c) for c in ("(doc_id::VARCHAR)", "source", "lang", "(n_chars::VARCHAR)", "{text}")) + ")"
_MERKLE_SQL = f"""WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, coalesce('=' || source, '') AS tree, {_LEAF_SQL.format(text="text")} AS leaf,
   {_LEAF_SQL.format(text="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS lowered,
   xor({_CRC_SQL.format("(doc_id::VARCHAR)")}, 4294967295) % 5 = 0 AS tampered FROM documents),
 l AS MATERIALIZED (SELECT doc_id, tree, leaf, CASE WHEN tampered THEN lowered ELSE leaf END AS shown,
   row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, count(*) OVER (PARTITION BY tree) AS n FROM d),
 t(lv, tree, p, n, h) AS (SELECT 0, tree, p, n, leaf FROM l UNION ALL
   SELECT lv + 1, tree, p // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY p)) FROM t WHERE n > 1 GROUP BY lv, tree, p // 16, n),
 g AS MATERIALIZED (SELECT tree, h, row_number() OVER (ORDER BY tree) - 1 AS p, count(*) OVER () AS n FROM t WHERE n = 1),
 u(lv, p, n, h) AS (SELECT 0, p, n, h FROM g UNION ALL
   SELECT lv + 1, p // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY p)) FROM u WHERE n > 1 GROUP BY lv, p // 16, n),
 a AS MATERIALIZED (SELECT x.lv, x.tree, x.p, x.n, coalesce(string_agg(y.h, '' ORDER BY y.p) FILTER (WHERE y.p < x.p), '') AS lft,
   coalesce(string_agg(y.h, '' ORDER BY y.p) FILTER (WHERE y.p > x.p), '') AS rgt
   FROM t x JOIN t y ON x.lv = y.lv AND x.tree = y.tree AND x.p // 16 = y.p // 16 WHERE x.n > 1 GROUP BY x.lv, x.tree, x.p, x.n),
 b AS MATERIALIZED (SELECT x.lv, x.p, x.n, coalesce(string_agg(y.h, '' ORDER BY y.p) FILTER (WHERE y.p < x.p), '') AS lft,
   coalesce(string_agg(y.h, '' ORDER BY y.p) FILTER (WHERE y.p > x.p), '') AS rgt
   FROM u x JOIN u y ON x.lv = y.lv AND x.p // 16 = y.p // 16 WHERE x.n > 1 GROUP BY x.lv, x.p, x.n),
 f(leaf_no, tree, lv, p, shown, proof, nodes) AS (SELECT p, tree, 0, p, shown, '', n FROM l UNION ALL
   SELECT f.leaf_no, f.tree, f.lv + 1, f.p // 16, sha256(lft || shown || rgt), proof || lft || rgt, (n + 15) // 16
   FROM f JOIN a ON a.tree = f.tree AND a.lv = f.lv AND a.p = f.p),
 k(leaf_no, tree, lv, p, shown, proof, nodes) AS (SELECT f.leaf_no, f.tree, 0, g.p, f.shown, f.proof, g.n FROM f JOIN g USING (tree) WHERE f.nodes = 1 UNION ALL
   SELECT k.leaf_no, k.tree, k.lv + 1, k.p // 16, sha256(lft || shown || rgt), proof || lft || rgt, (n + 15) // 16
   FROM k JOIN b ON b.lv = k.lv AND b.p = k.p)
 SELECT l.doc_id, l.leaf, g.h AS subroot, r.h AS root, sha256(k.proof) AS proof_sha256, k.shown AS folded_root, k.shown = r.h AS verified
 FROM l JOIN k ON k.leaf_no = l.p AND k.tree = l.tree AND k.nodes = 1 JOIN g ON g.tree = l.tree CROSS JOIN (SELECT h FROM u WHERE n = 1) r"""


@query("op11_merkle_manifest", _MERKLE_SQL)
def merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Every document as a leaf of its source's tree; of one id in five by checksum, the text is shown with A-Z lowered."""
    docs = table(spark, folder, "documents")
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    leaves = docs.select("doc_id", "source", merkle.leaf_hash("doc_id", "source", "lang", "n_chars", "text").alias("leaf"),
                         F.when(tampered, merkle.leaf_hash("doc_id", "source", "lang", "n_chars", lowered)).alias("shown"))
    return merkle.manifest(leaves, "doc_id", "source", "leaf", "shown")


def _codes_sql(parts: int = vectorcodes.PARTS, entries: int = vectorcodes.ENTRIES, rounds: int = vectorcodes.ROUNDS) -> str:
    """Integer k-means of every part, its rounds written out one after the other."""
    out = [f"""WITH f AS MATERIALIZED (SELECT vec_id, label, embedding AS e FROM embeddings
   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
 r AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, e) - 1 AS r, vec_id, label, list_transform(e, lambda x: floor({vectorcodes.SCALE} * x::DOUBLE)::BIGINT) AS v, len(e) // {parts} AS w FROM f),
 q AS MATERIALIZED (SELECT r, p, v[p * w + 1 : (p + 1) * w] AS v FROM r, range({parts}) t(p)),
 b0 AS MATERIALIZED (SELECT p, r AS c, v FROM q WHERE r < {entries})"""]
    for i in range(rounds + 1):
        out.append(f"""s{i} AS MATERIALIZED (SELECT r, p, min(d) AS d, arg_min(c, (d, c)) AS c FROM (SELECT q.r, q.p, b.c,
   list_sum(list_transform(list_zip(q.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM q JOIN b{i} b USING (p)) GROUP BY r, p)""")
        if i < rounds:
            out.append(f"""m{i} AS MATERIALIZED (SELECT p, c, list((t - ((t % n) + n) % n) // n ORDER BY j) AS v FROM (SELECT p, c, j, sum(x)::BIGINT AS t, count(*) AS n
   FROM (SELECT p, c, unnest(v) AS x, unnest(range(len(v))) AS j FROM q JOIN s{i} USING (r, p)) GROUP BY p, c, j) GROUP BY p, c),
 b{i + 1} AS MATERIALIZED (SELECT p, c, coalesce(m.v, b.v) AS v FROM b{i} b LEFT JOIN m{i} m USING (p, c))""")
    out.append(f"""o AS MATERIALIZED (SELECT r, string_agg(printf('%02x', c), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM s{rounds} GROUP BY r)
 SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, c)) FROM b{rounds}) AS codebooks_sha256 FROM r JOIN o USING (r)""")
    return ",\n ".join(out)


@query("op12_vector_codes", _codes_sql())
def vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    """Product code of every vector, its squared error, and the error of its label."""
    coded, _ = vectorcodes.compress(table(spark, folder, "embeddings"), "vec_id", "embedding", "label")
    return coded.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


@query("op13_personal_data")
def personal_data(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data of every whole text: counts and digest of the patterns' spans, and all spans with those the field adds."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = private.find(docs, private.fit(docs), keep_text=False)
    kinds = F.transform("base", lambda s: s["kind"])
    count = [(F.size("base") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in private.KINDS]
    return found.select("doc_id", *count, F.sha2(private.joined(F.col("base")), 256).alias("base_sha256"),
                        private.joined(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_added"))
