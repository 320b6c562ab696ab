"""From raw documents to packed training sequences: quality rules, shared lines, near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the documents of the next stage.  All stages but
the last return the columns of ``documents``.
"""
from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from thriftline.llm import jaccard_join, line_dedup, lp_packing, rule_cascade
from thriftline.plans.workspace import write_through

#: No SQL has the packing's vocabulary or its plan; the tests hold all stages against brute-force versions.
ORACLE_SQL = None


def apart(docs: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with all columns but doc_id and text renamed by position, and what gives them back in their order.

    An operator's own columns then clash with none of the input's.
    """
    own = [c if c in ("doc_id", "text") else f"input_{i}" for i, c in enumerate(docs.columns)]
    return docs.toDF(*own), lambda out: out.select(*own).toDF(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects.  A null text is too short, and goes."""
    rows, restored = apart(docs)
    return restored(rule_cascade.rule_cascade(rows).filter("kept"))


def shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that a document of smaller id holds too; n_chars counts what is left.

    A document that loses all its lines stays, with an empty text.
    """
    rows, restored = apart(docs)
    out = restored(line_dedup.line_dedup(rows))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the smallest id.

    Rows of equal id and text are one document, and so are documents without any
    word, which the stage before has emptied.  Documents without an id belong to
    no class, and stay.
    """
    classes = jaccard_join.jaccard_join(docs)
    first = classes.filter(F.col("doc_id") == F.col("class_id")).select(F.col("doc_id").alias("first")).distinct()
    rows, restored = apart(docs)
    blank = ~F.coalesce("text", F.lit("")).rlike(r"\S")
    first_blank = docs.filter(blank).agg(F.min("doc_id")).first()[0]
    usable = rows.filter("doc_id IS NOT NULL").filter(~blank | (F.col("doc_id") == F.lit(first_blank)))
    kept = usable.join(first, F.col("doc_id") == F.col("first"), "left_semi").dropDuplicates(["doc_id", "text"])
    nameless = rows.filter("doc_id IS NULL").dropDuplicates(["text"])
    return restored(kept.unionByName(nameless))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequence and place in it."""
    return lp_packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("shared_lines", shared_lines),
    ("near_duplicates", near_duplicates),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the rows of the last."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = write_through(stage(spark, docs, sf_dir), name)
    return docs
