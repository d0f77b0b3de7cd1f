"""Training corpus from documents: toxicity, language ID, near-duplicate removal, packing.

Each stage takes all that its predecessor kept. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from alnspark.llm import langid, neardup, packing, toxicity
from alnspark.llm.common import materialize


def aside(docs: DataFrame, *needed: str) -> DataFrame:
    """The needed columns, and all others in one, so that no column that a stage makes has the name of another."""
    others = [f"`{c}`" for c in docs.columns if c not in needed]
    return docs.select(*needed, (F.struct(*others) if others else F.lit(None)).alias("_others"))


def back(stage: DataFrame, docs: DataFrame, *needed: str) -> DataFrame:
    """The columns of docs again."""
    return stage.select(*[F.col(c) if c in needed else F.col("_others")[c].alias(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain doesn't reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    chain = toxicity.fit(docs, labels, toxicity.CATEGORIES)
    judged = toxicity.predict(aside(docs, "doc_id", "text"), chain)
    return back(judged.where(F.col("p_toxic") < toxicity.REJECT), docs, "doc_id", "text")


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a learned language, in whatever mixture: those without a letter, or with none of a script that a
    learned language is written in, go. All stay if there is nothing to learn from (no row with a text and a lang)."""
    model = langid.fit(docs)
    if not model.scripts:
        return docs
    labelled = langid.identify(aside(docs, "doc_id", "text"), model)
    return back(labelled.where("fit > 0"), docs, "doc_id", "text")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return neardup.deduplicate(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the remaining documents and their places in the sequences."""
    return packing.pack(docs, carry={"ids_crc32": F.crc32("ids")})


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("language", drop_unknown_language),
    ("near_duplicates", drop_near_duplicates),
    ("packing", pack),
]

#: SQL can express neither the fitted models nor the tokenizer; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
