"""A training-corpus pipeline of five stages, each a function of (spark, docs, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqsieve.llm import language_id, minhash_dedup, mixing, pii, sentencepieces
from seqsieve.llm.common import materialize
from seqsieve.llm.queries import MODEL_FILE

#: Documents that share so much of their five-word shingles are near copies.
PERCENT = 80


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a language: null texts and texts without a letter. Rows are independent; where no label is known, every text with a letter stays."""
    model = language_id.fit(docs.select("doc_id", "text", "lang"))
    if not model[0]:  # no labels to learn from
        return docs.where(F.col("text").rlike(r"\p{L}"))
    told = language_id.predict(docs.select(F.struct("*").alias("row"), "text"), model)
    return told.where("lang_pred <> 'und'").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of similarity PERCENT or more.

    Rows that share an id are one document: of those that stay, the first by text, then by a hash of
    all columns. Rows without an id are linked with nothing and stay, as do empty texts with an id of
    their own.
    """
    groups = minhash_dedup.near_duplicates(docs, PERCENT).where("doc_id is not null").groupBy("doc_id").agg(F.min("kept").alias("kept"), F.count("*").alias("n"))
    groups = materialize(groups.where("not kept or n > 1"))
    out = docs.join(groups.select("doc_id").hint("shuffle_hash"), "doc_id", "left_anti").select(*docs.columns)
    again = groups.where("kept")
    if again.limit(1).count():
        hashed = F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns))
        same = docs.join(again.select("doc_id").hint("shuffle_hash"), "doc_id", "left_semi").select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"), F.col("text").alias("body"), hashed.alias("hash"))
        nth = F.row_number().over(Window.partitionBy("id").orderBy("body", "hash"))
        first = same.withColumn("nth", nth).where("nth = 1").select("row.*")
        out = out.unionByName(first)
    return out


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by the name of its kind; rows are independent, null texts stay null."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the target weights ask for; null sources are one source, rows equal in id and text are taken together."""
    return mixing.mixed(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of whole texts, packed as little-endian int32, with what the text decodes to agreeing; a null text has null tokens."""
    coded = sentencepieces.encode(docs.select("doc_id", "text", "lang", "source"), MODEL_FILE, decoded="decoded")
    return coded.select("doc_id", "lang", "source", "n_tokens", "tokens", F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))


STAGES = [
    ("language ID", identify_language),
    ("MinHash near-dedup", drop_near_duplicates),
    ("PII", redact_personal_data),
    ("mixing", mix_sources),
    ("SentencePiece", encode_pieces),
]

#: The stages hold fitted classifiers and a tokenizer, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for nth, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if nth + 1 < len(STAGES):
            docs = materialize(docs)
    return docs
