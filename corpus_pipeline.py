"""A training corpus from raw documents: quality, near-duplicates, secrets, mixing, token ids.

Each stage works on all that the one before it kept, given as a DataFrame with
the columns of ``documents``; all but the last return those columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import bpe, common, mixing, quality, secrets, simhash

#: A document goes if junk is likelier than not, so that clean ones in doubt stay.
REJECT_BELOW = 0.5


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose quality score is below ``REJECT_BELOW``; the labelled ones of them teach, but for the held-out ids.

    Null and empty texts have a score, too; repeated rows go or stay together; an
    empty table, or one without labelled documents, loses nothing that a model of
    no evidence wouldn't reject.
    """
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model, name="__score").where(F.col("__score") >= REJECT_BELOW).drop("__score")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group whose sets of five words have a cosine of 0.8 or more, by links.

    Null and blank texts are one group; rows with a null id stay; of rows that share
    an id one stays; an empty table stays empty.
    """
    return simhash.keep_one(docs, similarity=0.8)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts a mark in the place of each secret and linked credential; no document goes.

    Null and empty texts, repeated rows and an empty table stay as they are.
    """
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and samples documents so that each source's words come to its target.

    Rows without words add none and go; null ids and repeated rows take part like
    others; an empty table stays empty.
    """
    return mixing.mix(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids: a row for each turn of a document in the mix.

    A null or empty text would have no ids; null ids and repeated rows stay; an
    empty table gives no rows.
    """
    rows = bpe.encode(docs, bpe.vocabulary())
    return rows.select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality classifier", keep_quality),
    ("SimHash near-dedup", drop_near_duplicates),
    ("secret scans", redact_secrets),
    ("mixing sources", mix_sources),
    ("BPE encoding", encode_tokens),
]

#: Hashing, fitting and merging can't be expressed in SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written and read again; what a stage has written besides is deleted."""
    docs = common.documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES[:-1]):
        with common.tidy(spark):
            docs = common.stage(stage(spark, docs, sf_dir), f"stage-{i + 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
