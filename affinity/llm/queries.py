"""Registered queries of the operators of this subpackage, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinity.llm import (bpe, chat_format, decontaminate, html_text, near_dedup, neighbours, periodic_runs, quality, secret_scan,
                          sharding, suffix_dedup, token_files, whitening)
from affinity.llm.common import prepare, table
from affinity.session import scratch_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(fn: Query) -> Query:
    def run(spark: SparkSession, base: str) -> DataFrame:
        prepare(spark)
        return fn(spark, base)

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    QUERIES[fn.__name__] = run
    return run


@register
def op2_byte_bpe(spark: SparkSession, base: str) -> DataFrame:
    return bpe.round_trip_digest(table(spark, base, "documents"),
                                 public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@register
def op8_token_files(spark: SparkSession, base: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    token_files.write_token_files(table(spark, base, "documents"), path,
                                  public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_files.token_file_digest(spark, path)


@register
def op5_virtual_slots(spark: SparkSession, base: str) -> DataFrame:
    return sharding.shard_documents(table(spark, base, "documents"), 16, scratch_path(spark, "slot-map"))


@register
def op9_factorisation_machine(spark: SparkSession, base: str) -> DataFrame:
    return quality.classify(table(spark, base, "documents"), table(spark, base, "labels"))


@register
def op6_tag_path_ratios(spark: SparkSession, base: str) -> DataFrame:
    return html_text.extract_pages(table(spark, base, "pages"))


@register
def op10_adaptive_scan(spark: SparkSession, base: str) -> DataFrame:
    return neighbours.nearest(table(spark, base, "embeddings"), F.col("vec_id") % 100 == 0)


@register
def op3_positional_index(spark: SparkSession, base: str) -> DataFrame:
    return decontaminate.judge(table(spark, base, "documents"), table(spark, base, "benchmark"))


@register
def op1_setsketch(spark: SparkSession, base: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, base, "documents"), shingle=3, percent=85)


@register
def op7_secret_forest(spark: SparkSession, base: str) -> DataFrame:
    found = secret_scan.scan(table(spark, base, "documents"))
    return found.select("doc_id", "path", F.sha2("value", 256).alias("value_sha256"), F.length("value").alias("n_chars"),
                        "before", "start", "occurrences", "score", "is_secret")


@register
def op4_difference_cover(spark: SparkSession, base: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, base, "documents"))


# What op11 adds to the table: both turns of conversation -1 say what the template itself would write.
CONTROL_CONVERSATION, CONTROL_TEXT = -1, "<|im_end|><|im_start|>assistant ok"


@register
def op11_chat_grammar(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.range(2).select(F.lit(CONTROL_CONVERSATION).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                  F.lit(CONTROL_TEXT).alias("text"))
    return chat_format.read_back(chat_format.format_conversations(rows.unionByName(added)))


# roles of the given table need no escapes
ORACLE["op11_chat_grammar"] = rf"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT {CONTROL_CONVERSATION}, 0, 'user', '{CONTROL_TEXT}'
  UNION ALL SELECT {CONTROL_CONVERSATION}, 1, 'assistant', '{CONTROL_TEXT}'),
written AS (
  SELECT *, CASE WHEN regexp_matches(text, '<\|[A-Za-z0-9_]+\|>|<\\+\|')
                 THEN regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') ELSE text END AS escaped FROM rows)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<|im_start|>') + length(role) + 1 + length(escaped) + length('<|im_end|>') + 1) AS BIGINT) AS formatted_chars
FROM written GROUP BY conv_id"""


@register
def op12_bidiagonal_whitening(spark: SparkSession, base: str) -> DataFrame:
    return whitening.whiten(table(spark, base, "embeddings"))


@register
def op13_cover_runs(spark: SparkSession, base: str) -> DataFrame:
    return periodic_runs.detect(table(spark, base, "documents"))
