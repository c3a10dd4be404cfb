"""The corpus pipeline: stages applied to ``documents``, each written and read again as the next one's input.

Language identification drops texts without a letter (all, where no row has a language to learn from), near-duplicate removal keeps the document
with the smallest id of each group, the secret scan blanks what it finds, the mix takes each document
as often as its source's target asks, and what is left is encoded and decoded again. No stage samples or caps rows.
Rows without id take part in every stage. SQL cannot express the learned stages, so
``ORACLE_SQL`` is None; the tests compare the stages with brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.language_id import keep_identified
from tidemark.llm.language_id import train as train_language
from tidemark.llm.mixing import take_mix
from tidemark.llm.near_dedup import near_duplicates
from tidemark.llm.pieces import decode, encode
from tidemark.llm.queries import PIECES
from tidemark.llm.secret_scan import redact
from tidemark.llm.shared import keep

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    return keep_identified(docs, train_language(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity 0.8 or more: one document of each group stays.

    Rows of one id share a decision, and of equal texts under one id one row stays. A row without id takes
    part under a hash of its text from 2^62 upwards, so documents with usual ids go first. Blank texts stay.
    """
    key = F.coalesce("doc_id", F.xxhash64("text").bitwiseAND((1 << 62) - 1).bitwiseOR(1 << 62))
    docs = docs.select(*COLUMNS).withColumn("key", key)
    found = keep(near_duplicates(docs.select(F.col("key").alias("doc_id"), "text")), "found").withColumnRenamed("doc_id", "key")
    dropped = found.where("not kept").select("key").distinct()
    repeated = found.where("n_shingles > 0").groupBy("key").count().where("count > 1").select("key")
    if repeated.isEmpty():
        return docs.join(dropped, "key", "left_anti").select(*COLUMNS)
    repeated = keep(repeated.join(dropped, "key", "left_anti"), "repeated")
    single = docs.join(dropped.union(repeated), "key", "left_anti").select(*COLUMNS)
    one = docs.join(repeated, "key", "left_semi").groupBy("key", "text").agg(F.min(F.struct("doc_id", "lang", "source", "n_chars")).alias("row"))
    return single.union(one.select("row.doc_id", "text", "row.lang", "row.source", "row.n_chars"))


def blank_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact(docs.select(*COLUMNS)).selectExpr("doc_id", "text", "lang", "source", "cast(length(text) as bigint) as n_chars")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return take_mix(docs.select(*COLUMNS))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, decoded_sha256): the pieces of each text, and the digest of the text they give back."""
    decoded = decode(encode(docs.select(*COLUMNS), PIECES), PIECES)
    return decoded.select("doc_id", "ids", F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("language ID", identify_languages),
    ("MinHash near-dedup", drop_near_duplicates),
    ("secret scans", blank_secrets),
    ("mixing sources to target weights", mix),
    ("SentencePiece encoding and decoding", encode_pieces),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            docs = keep(docs, f"stage{number}")
    return docs
