"""From raw documents to token ids: toxicity, line dedup, near-dedup, mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents.  A stage's result is written as Parquet and read again by the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockloom.llm import bpe, lines, mixing, neardup, toxicity
from stockloom.llm.common import stored

#: The stages learn, hash and shuffle in ways SQL cannot express; the tests compare them with brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays under the threshold; the model learns from the labels table."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model).where(F.col("toxicity") < toxicity.TOXIC_FROM).select(docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that an earlier line matches; n_chars follows the text."""
    return lines.dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group on five-word shingles; rows without a doc_id all stay."""
    gone = neardup.near_duplicates(docs, width=5).where("not kept").select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    # Rows that share a doc_id are one group; of each, the least row stays.
    rest = [c for c in docs.columns if c != "doc_id"]
    one = kept.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct(F.col("text"), *[c for c in rest if c != "text"])).alias("r"))
    return one.select("doc_id", *[F.col(f"r.{c}").alias(c) for c in rest]).select(docs.columns).union(kept.where("doc_id is null"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it; a part served last counts from half on."""
    taken = mixing.mix(docs)[0].groupBy(F.col("doc_id").alias("_id")).agg(F.sum("taken").alias("_taken"), F.sum("size").alias("_size"))
    copies = F.floor(F.col("_taken") / F.col("_size") + 0.5).cast("int")
    times = taken.where("_size > 0").select("_id", copies.alias("_copies")).where("_copies > 0")
    return (docs.join(times, F.col("doc_id").eqNullSafe(F.col("_id")))
            .withColumn("_copy", F.explode(F.sequence(F.lit(1), "_copies"))).select(docs.columns))


def encode_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document (little-endian unsigned 32-bit), their number and digests."""
    coded = bpe.encode(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "token_ids")


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("near_dedup", drop_near_copies), ("mixing", mix_sources), ("byte_bpe", encode_bytes)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the whole documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
