"""Each operator over its whole benchmark table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeweave.llm.decontaminate import contaminated
from lakeweave.llm.language_model import score_texts
from lakeweave.llm.letter_runs import letter_words
from lakeweave.llm.near_dedup import near_duplicates
from lakeweave.llm.packing import best_fit_packing, word_counts
from lakeweave.llm.periodic_runs import periodic_runs
from lakeweave.llm.pii import find_pii
from lakeweave.llm.quality_model import score_quality
from lakeweave.llm.quality_rules import quality_rules
from lakeweave.llm.secrets import find_secrets
from lakeweave.llm.spelling import spelling_variants
from lakeweave.llm.token_counts import VOCABULARY, token_counts
from lakeweave.llm.token_output import packed_tokens
from lakeweave.llm.toxicity import score_toxicity
from lakeweave.llm.words import words


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(word_counts(table(spark, sf_dir, "documents")))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_tokens(table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(letter_words(table(spark, sf_dir, "documents"), least=5, lost=97).where("n >= 3"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def with_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, text): every tenth text, by a hash of its id, repeats some of its words up to its end by a rule."""
    h, w = F.crc32(F.col("doc_id").cast("string").cast("binary")), words(F.col("text"))
    g, n = F.floor(F.col("h") / 10), F.size("w")
    planted = docs.select("doc_id", "text", h.alias("h")).withColumn("w", F.when(F.col("h") % 10 == 0, w))
    planted = planted.withColumn("a", F.when(n > 0, (g % n).cast("int")))
    left = n - F.col("a")
    planted = planted.withColumn("p", (1 + F.floor(left / (3 + g % 8))).cast("int"))
    block = F.slice("w", F.col("a") + 1, F.col("p"))
    tail = F.slice(F.flatten(F.array_repeat(block, F.ceil(left / F.col("p")).cast("int"))), 1, left)
    text = F.concat_ws(" ", F.slice("w", F.lit(1), F.col("a")), tail)
    return planted.select("doc_id", F.when(F.col("a").isNotNull(), text).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_repeats(table(spark, sf_dir, "documents")))
    order = lambda r: F.struct(r["length"].alias("l"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    best = found.withColumn("best", F.array_max(F.transform("runs", order)))
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.s")).alias("start"),
        F.col("best.l").alias("length"),
        (-F.col("best.p")).alias("period"),
        F.expr("1000 * best.l div -best.p").alias("exponent_milli"),
        F.sha2(F.concat_ws("", F.transform("runs", line)), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {
    "op1_secret_scans": op1_secret_scans,
    "op2_decontamination": op2_decontamination,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_pii": op5_pii,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_minhash_near_dedup": op7_minhash_near_dedup,
    "op8_quality_rules": op8_quality_rules,
    "op9_toxicity": op9_toxicity,
    "op10_token_output": op10_token_output,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_token_counts": op12_token_counts,
    "op13_periodic_runs": op13_periodic_runs,
}
