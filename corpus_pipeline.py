"""A corpus pipeline: five operators, each stage written and read by the next.

Stages take ``(spark, docs, sf_dir)`` and, but for the last, return the columns of
``documents``.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm import bpe, mixing, quality, secrets, simhash
from sightline.llm.frames import fresh, numbered, shared_folder, table
from sightline.llm.queries import RANKS

#: The columns of documents.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    Null and empty texts are scored as empty; repeated rows are scored alike; without
    usable labels every score is 0.5 and all stay; an empty table gives no rows.
    """
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return docs.select(*COLUMNS).where(quality.score_column(model, F.col("text")) >= quality.THRESHOLD)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, with or without an id.

    The least id stays, null ids last; of rows that tie in all columns one does.
    Null and empty texts are one group; an empty table gives no rows.
    """
    return simhash.deduplicate(docs.select(*COLUMNS))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kind; every document stays.

    Null texts stay null and keep their ``n_chars``; else it is counted anew.
    Repeated rows each return; an empty table gives no rows.
    """
    clean = docs.select("doc_id", secrets.redacted(F.col("text")).alias("text"), "lang", "source", "n_chars")
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document comes as often as the mix takes it, 0 to 3 times.

    Every row has a number of its own, so null and repeated ids and rows alike in
    all columns are taken as the mix says. Null and empty texts have no words and
    are not taken; a null source is one of its own; an empty table gives no rows.
    """
    keyed, key = numbered(docs.select(*COLUMNS))
    (copy,) = fresh(keyed, "copy")
    copies = mixing.mix(keyed, carry=tuple(key)).where("copies > 0").select(*key, F.col("copies").cast("int").alias("copies"))
    taken = keyed.join(copies.hint("shuffle_hash"), key)
    return taken.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the bytes decoded from them.

    Null and empty texts have no tokens; repeated rows each return; an empty table
    gives no rows.
    """
    return bpe.round_trip(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


STAGES = [("quality_filter", quality_filter), ("near_dedup", near_dedup), ("secret_scan", secret_scan), ("source_mix", source_mix), ("encode", encode)]

#: A learned classifier and the fitting of budgets aren't expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; what they return in between is written to a folder
    of its own beside the checkpoints and goes once the next stage is written. The
    last of these folders is what the result reads, so it stays."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
        if k:
            before = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
            before.getFileSystem(spark._jsc.hadoopConfiguration()).delete(before, True)
    return docs
