"""From raw documents to packed training sequences.

Language ID rejects documents without a language, SimHash keeps one of each near-duplicate group,
repeated passages are cut, sources are mixed to their weights, and the rest is packed.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stormlens.llm import language, mixing, packing, simhash, substring
from stormlens.llm.common import bucket_of, read
from stormlens.session import ensure_checkpoint_dir

#: A document whose best language scores less belongs to none.
MIN_LANGUAGE_SCORE = 0.3
TOKENIZER = "word_bpe_49k.json"


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that are `und` or score below MIN_LANGUAGE_SCORE; fills a missing lang.

    Where no document carries a language, none can be learned and only texts without a letter go.
    """
    net = language.learn(docs, bucket_of("doc_id", 4) != 2)
    got = language.identify(docs, net)
    good = F.col("__row.text").rlike(r"\p{L}")
    if net.labels:
        good = (F.col("lang_pred") != language.UNDETERMINED) & (F.col("score") >= MIN_LANGUAGE_SCORE)
    fill = F.coalesce("__row.lang", F.when(F.col("lang_pred") != language.UNDETERMINED, F.col("lang_pred")))
    return got.where(good).select(*[fill.alias(c) if c == "lang" else F.col(f"__row.`{c}`").alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near duplicates."""
    return simhash.keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts words covered by a repeated window; a document of which nothing is left goes."""
    got = substring.drop_repeats(docs).where("__removed = 0 or text <> ''")
    n_chars = F.when(F.col("__removed") > 0, F.length("text")).otherwise(F.col("n_chars"))
    return got.withColumn("n_chars", n_chars.cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents so that sources meet their target weights; globally shuffled."""
    return mixing.repeat(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and offset."""
    return packing.pack_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("language_id", identify_language), ("simhash_near_dedup", near_dedup), ("substring_dedup", substring_dedup),
          ("source_mixing", mix_sources), ("best_fit_packing", pack)]
#: Learned languages, XXH64 and token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result but the last is written to the shared folder and read again."""
    base = f"{ensure_checkpoint_dir(spark)}/corpus-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{base}/{k}-{name}")
            docs = spark.read.parquet(f"{base}/{k}-{name}")
    return docs
