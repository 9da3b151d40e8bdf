"""Corpus pipeline: from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir), works on every row of ``docs`` and
returns a DataFrame, which is written as Parquet and read again as the next
stage's ``docs``. All but the last return the columns of ``documents``; further
columns of ``docs`` stay as they are. Repeated rows stay rows of their own,
except that near_dedup takes them for copies; an empty table gives an empty
result; texts count in full however long they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import line_crf, packing, secrets
from tidemark.llm.common import Scratch, drop_paths, table, written
from tidemark.llm.queries import PACKING_VOCABULARY
from tidemark.llm.quality_rules import quality_column
from tidemark.llm.simhash import near_duplicate_groups


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that fail go; documents that fail the base rules or lose too much go.

    A null text counts as empty and goes.
    """
    verdict = "verdict"
    while verdict in docs.columns:
        verdict = f"_{verdict}"
    # A generator's input is worked out once a row; a filter would be a second time.
    passing = F.filter(F.array(quality_column(F.col("text"))), lambda q: q["kept"])
    clean = docs.select("*", F.explode(passing).alias(verdict)).withColumn("text", F.col(verdict)["clean_text"])
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores low go; null and empty texts score 0.

    It learns from the raw documents, of which the rules have taken away most
    of the bad ones by now.
    """
    model = line_crf.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return line_crf.keep_good(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of copies and near copies the smallest doc_id stays.

    Rows that repeat a doc_id count as copies. A row without doc_id stays.
    Null and empty texts are copies of one another.
    """
    scratch = Scratch(spark)
    named = docs.where("doc_id is not null")
    groups = near_duplicate_groups(named)
    kept = scratch.table(groups.where("doc_id = component_id").groupBy("doc_id").count(), "kept")
    # Ids are as many as documents, so they are joined the same way at any size.
    stay = named.join(kept.where("count = 1").select("doc_id").hint("merge"), "doc_id", "left_semi")
    if not kept.where("count > 1").isEmpty():
        again = named.join(kept.where("count > 1").select("doc_id").hint("merge"), "doc_id", "left_semi")
        stay = stay.unionByName(again.dropDuplicates(["doc_id"]))
    return stay.unionByName(docs.where("doc_id is null")).select(docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by their kind in brackets; null texts stay null."""
    return secrets.redact_secrets(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of 2048 tokens.

    A null text counts as empty: its piece is the closing token alone.
    """
    return packing.pack(docs, *PACKING_VOCABULARY)


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]

#: The classifier, the near-duplicate groups and the packing are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs, path = written(stage(spark, docs, sf_dir), name)
        if before:
            drop_paths(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
