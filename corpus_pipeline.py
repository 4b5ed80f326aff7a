"""A corpus pipeline over `documents`: toxicity, near duplicates, secrets, mixing, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm import mixing, packing, secrets, simhash, toxicity
from sievework.session import cut, discard

MARK = "<secret>"
# The columns of `documents` that stages read; all others pass by untouched.
READ = ("doc_id", "text", "lang", "source", "n_chars")


def _keeping_columns(docs: DataFrame, change: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """`change` applied while the columns beyond READ have fresh names, then all columns as they were."""
    names = [n if n in READ else f"column_{i}" for i, n in enumerate(docs.columns)]
    return change(docs.toDF(*names)).select(*names).toDF(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold.

    Null and empty texts score low and stay; repeated rows get the same score, so all stay or all go;
    without labels nothing is rejected; an empty table gives no rows.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _keeping_columns(docs, lambda d: toxicity.toxic_documents(d, labels).filter("_toxic_predicted = 0"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near duplicates, the one with the smallest id.

    Null and empty texts form one group; of rows that repeat the kept id one stays, the smallest by a
    hash of the row; a group without any id keeps one row; an empty table gives no rows.
    """
    return simhash.drop_near_duplicates(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; secrets in texts are replaced by MARK and `n_chars` follows.

    Null and empty texts stay as they are, repeated rows are changed alike, no row is added or lost.
    """
    def change(d: DataFrame) -> DataFrame:
        changed = F.col("_spans") != ""
        columns = {"text": F.when(changed, F.col("_redacted")).otherwise(F.col("text"))}
        if "n_chars" in d.columns:
            kind = d.schema["n_chars"].dataType
            columns["n_chars"] = F.when(changed, F.length("_redacted").cast(kind)).otherwise(F.col("n_chars"))
        return secrets.find_secrets(d, redact=MARK).withColumns(columns)

    return _keeping_columns(docs, change)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled at rates raked to the target shares of source, language and topic.

    A document whose rate is above one comes more than once. Null sources and languages are a category
    of their own; texts without words weigh nothing and follow their cell's rate; repeated rows of an id
    share their fate; an empty table gives no rows.
    """
    copy = F.explode(F.array_repeat(F.lit(0), F.col("_copies").cast("int")))
    return _keeping_columns(docs, lambda d: mixing.mixed_documents(d).filter("_sampled").withColumn("_copy", copy))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents left with their token ids, sequence and offset.

    Null and empty texts are one end id, repeated rows are packed each, ties are ordered by document,
    start and checksum; an empty table gives no rows.
    """
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_copies),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("packing", pack),
]
# Trained models, fingerprints and tokenizers are beyond SQL; tests compare stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`, each written as Parquet in the shared folder and read again.

    A stage's input is deleted once its output is written. Cases: nulls, empty texts and repeated rows
    pass as each stage states; an empty table gives no rows; extra columns of `documents`, whatever
    their names and types, are kept as they are up to packing.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        before, docs = docs, cut(stage(spark, docs, sf_dir))
        discard(before)
    return docs
