"""One thin query per operator: it applies the operator to a whole table and derives the columns to compare."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pluvian.llm.chats import format_chats, read_back
from pluvian.llm.collocations import collocations
from pluvian.llm.decontaminate import benchmark_overlaps
from pluvian.llm.html import extract_main_text
from pluvian.llm.idfiles import read_ids, write_ids
from pluvian.llm.mixing import mix_sources
from pluvian.llm.quality import quality_rules
from pluvian.llm.ranking import search
from pluvian.llm.scoring import pseudo_likelihood
from pluvian.llm.secrets import KINDS, find_secrets, spelled
from pluvian.llm.simhash import near_duplicates
from pluvian.llm.substrings import remove_repeats
from pluvian.llm.urls import Rule, filter_urls
from pluvian.session import fresh_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents under a network trained on all of them."""
    return pseudo_likelihood(table(spark, sf_dir, "documents"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per contaminated document, with the test items it repeats."""
    found = benchmark_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.groupBy(F.col("key").alias("doc_id")).agg(
        F.array_sort(F.collect_set("item")).alias("item_ids"), F.count(F.lit(1)).alias("n_overlaps"),
        F.max(F.col("end") - F.col("start")).cast("bigint").alias("longest"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


URL_RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"),
             Rule("allow", "org", "/fr/"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urls end in the number of the document they show; its labels mark the url as bad."""
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    number = F.regexp_extract("url", r"/([0-9]{1,18})(?:/|\.html)?(?:[?#]|$)", 1)
    shown = pages.select("url", F.when(number != "", number).cast("bigint").alias("doc_id"))
    marks = shown.join(labels, "doc_id").select("url", ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return filter_urls(pages, marks, URL_RULES).withColumn("bad_rate", F.round("bad_rate", 6))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                  F.lit("</s>[INST] ok [/INST]").alias("text"))
    read = read_back(format_chats(chats.unionByName(probe)))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    one = read.select("conv_id", "example", F.size("turns").cast("bigint").alias("n_turns"),
                      F.sha2(turns, 256).alias("turns_sha256"), "loss_text", "n_chars")
    loss = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "loss_text"))),
                                    lambda x: x["loss_text"]), "")
    return one.groupBy("conv_id").agg(
        F.max("n_turns").alias("n_turns"), F.max_by("turns_sha256", "example").alias("turns_sha256"),
        loss.alias("loss"), F.sum("n_chars").alias("formatted_chars")).select(
        "conv_id", "n_turns", "turns_sha256", F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), shingle=4, radius=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["rank"] == KINDS.index(kind))).cast("bigint")

    found = find_secrets(table(spark, sf_dir, "documents"), ["doc_id"])
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in KINDS[:3]],
                        F.sha2(spelled(F.col("base")), 256).alias("base_sha256"), spelled(F.col("spans")).alias("spans"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"), ["page_id", "url"]).withColumn(
        "n_chars", F.length("text").cast("bigint"))


def op11_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents, written to id files and read back from them."""
    import public_tokenizers
    path = fresh_path(spark, "ids")
    write_ids(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return read_ids(spark, path).select("doc_id", "start", (F.length("ids") / 4).cast("bigint").alias("n_tokens"),
                                        F.crc32("ids").alias("ids_crc32"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 documents that match each benchmark item best."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))
