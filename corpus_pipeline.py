"""A corpus prepared for training: five stages over ``documents``, each a table.

Every stage takes the table that its predecessor kept. All but the last return the columns
of ``documents``: quality rules drop what they reject, near-duplicate detection keeps one document
of each group, decontamination drops documents that hold a benchmark passage, and the secret scan
replaces secrets in the text. The last stage packs what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeweave.llm.decontaminate import contaminated
from lakeweave.llm.near_dedup import near_duplicates
from lakeweave.llm.packing import best_fit_packing, word_counts
from lakeweave.llm.quality_rules import keep_good
from lakeweave.llm.secrets import find_secrets, redact
from lakeweave.llm.shared import ROW_KEY, Scratch, anti_join, semi_join, with_row_key

# No SQL: zstandard and best-fit packing are beyond it. The tests compare with brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; each row stands and falls by its own text."""
    return keep_good(docs)


def keyed(docs: DataFrame) -> DataFrame:
    """Key and text of every row, for operators that tell documents apart by ``doc_id``."""
    return docs.select(F.col(ROW_KEY).alias("doc_id"), "text")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id.

    Rows of one id and text are one document. Rows without an id, and different texts under one id, are documents of
    their own, which a hash stands for; a group of such keeps the one with the smallest.
    """
    scratch = Scratch(spark)
    rows = with_row_key(docs, scratch)
    found = scratch.save(near_duplicates(keyed(rows)).select(F.col("doc_id").alias(ROW_KEY), "kept"), "found")
    out = anti_join(rows, found.where("NOT kept").select(ROW_KEY).distinct(), ROW_KEY)
    repeated = found.where("kept").groupBy(ROW_KEY).count().where("count > 1").select(ROW_KEY)
    if not repeated.isEmpty():
        one = semi_join(out, repeated, ROW_KEY).groupBy(ROW_KEY).agg(
            F.min_by(F.struct(*docs.columns), F.to_json(F.struct(*docs.columns))).alias("row")
        )
        out = anti_join(out, repeated, ROW_KEY).select(*docs.columns).unionByName(one.select("row.*"))
    return out.select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage, each row by its own text."""
    rows = with_row_key(docs, Scratch(spark))
    found = contaminated(keyed(rows), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return anti_join(rows, found.select(F.col("doc_id").alias(ROW_KEY)).distinct(), ROW_KEY).select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced; ``n_chars`` is the length of the new text."""
    return redact(docs, find_secrets(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins that hold every document once."""
    return best_fit_packing(word_counts(docs))


STAGES = [
    ("quality_rules", quality),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scans", secret_scan),
    ("best_fit_packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bins of what is left of ``documents``; every stage is written and read again."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
