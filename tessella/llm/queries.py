"""The registered queries of this folder: thin digests of what the operators return."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import chat_format, decontamination, html_text, jaccard_join, media, packing, quality, substring_dedup, toxicity, url_filters
from tessella.llm.common import table
from tessella.llm.oracles import ORACLES

#: The path rules of the URL filter.
URL_RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = quality.fit(docs, table(spark, sf_dir, "labels").filter(~held), "quality")
    scored = quality.score(docs, model)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), "toxic")
    return toxicity.score(docs.select("doc_id", "text"), model).select(
        "doc_id", F.round("severity", 6).alias("severity"), F.round("toxicity", 6).alias("toxicity"), F.col("rejected").cast("int").alias("toxic")
    )


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = "</s>[INST] ok [/INST]"
    extra = spark.sql(
        "SELECT -1L AS conv_id, * FROM VALUES (0L, 'user', :hard), (1L, 'assistant', :hard) AS t(turn, role, text)", args={"hard": hard}
    )  # an inline table of literals
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    read = chat_format.read_back(chat_format.format_chats(rows))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    less = substring_dedup.changed(docs).select("row", "n_removed", "kept_sha256")
    return substring_dedup.untouched(docs).join(less, "row", "left").select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("kept_sha256", "whole_sha256").alias("kept_sha256")
    )


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = media.media_columns(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", F.col("length").alias("media_bytes"), "media_sha256",
        "feature", "width", "height", "depth",
    )


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's outcome is the label of the document that its path names: bad where quality
    is 0 or toxic is 1."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(
        F.max(((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")).alias("bad")
    )
    named = pages.select(
        url_filters.host_of(F.col("url")).alias("host"),
        F.regexp_extract(url_filters.path_of(F.col("url")), r"^/[^/]*/([0-9]{1,18})", 1).try_cast("long").alias("doc_id"),
    )
    outcomes = named.join(labels, "doc_id", "left").select("host", "bad")
    judged = url_filters.filter_urls(pages, outcomes, URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.main_text(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link_components(table(spark, sf_dir, "documents"))


def queries() -> dict:
    found = (op1_quality, op2_toxicity, op3_chat_format, op4_substring_dedup, op5_media_columns, op6_url_filter, op7_packing, op8_html_text, op9_decontamination, op10_jaccard_join)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
