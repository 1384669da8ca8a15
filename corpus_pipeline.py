"""The corpus pipeline: five stages from raw documents to a mix, each written as Parquet and read again by the next.

A stage takes (spark, docs, sf_dir) and judges all the documents its predecessor kept; all but the last return the columns of
`docs`. Rows go through whole, so columns of any name survive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pluvian.llm.columns import identity, with_row
from pluvian.llm.decontaminate import benchmark_overlaps
from pluvian.llm.mixing import mix_sources
from pluvian.llm.quality import quality_rules
from pluvian.llm.secrets import find_secrets, redacted
from pluvian.llm.simhash import one_of_each
from pluvian.session import written


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    rows = with_row(docs, "doc_id", "lang", "text")
    judged = quality_rules(rows, _table(spark, sf_dir, "labels"), carry=("_row",))
    return judged.where("kept").select("_row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies: that with the smallest id."""
    return one_of_each(docs, shingle=4, radius=4)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that repeat no benchmark item."""
    found = benchmark_overlaps(docs, _table(spark, sf_dir, "benchmark"))
    leaks = found.select(identity(F.col("key"), F.col("h1")).alias("id"), "h1").distinct()
    rows = with_row(docs, "doc_id", "text").withColumn("h1", F.xxhash64("text"))
    rows = rows.select("_row", "h1", identity(F.col("doc_id"), F.col("h1")).alias("id"))
    return rows.join(leaks, ["id", "h1"], "left_anti").select("_row.*")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret replaced by a mask, and the length of the text they now have."""
    found = find_secrets(with_row(docs, "text"), ["_row"])
    text = redacted(F.col("_row.text"), F.col("spans"))
    changed = found.select("_row", text.alias("_text"), (F.size("spans") > 0).alias("_hit"))
    length = F.when(F.col("_hit"), F.length("_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_row.n_chars"))
    new = {"text": F.col("_text"), "n_chars": length}
    return changed.select(*[new.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the mix takes, with `copies`, how often it takes each; those it takes not at all go."""
    taken = mix_sources(with_row(docs, "doc_id", "text", "source"), carry=("_row",))
    return taken.where("copies > 0").select("_row.*", "copies")


STAGES = [("quality_rules", quality), ("simhash_dedup", near_dedup), ("decontaminate", decontaminate),
          ("secret_scan", mask_secrets), ("mix_sources", mix)]

#: Fingerprints, spaced seeds and the test battery have no SQL form; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
