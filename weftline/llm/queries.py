"""The queries of the ten operators, and their SQL where SQL can express them."""

from __future__ import annotations

from weftline.llm.chat_format import conversations, link_quotes
from weftline.llm.decontaminate import edit_hits
from weftline.llm.exact_dedup import exact_groups, exact_sql
from weftline.llm.language_id import identify
from weftline.llm.line_dedup import line_report, line_sql
from weftline.llm.mixing import mix_report, mix_sql
from weftline.llm.secret_scan import secret_report, secret_sql
from weftline.llm.sharding import shard_report
from weftline.llm.simhash_dedup import hex_digits, near_components
from weftline.llm.url_filter import url_report, url_sql


def _read(spark, sf_dir, table):
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_url_filter(spark, sf_dir):
    return url_report(_read(spark, sf_dir, "pages"))


def op2_simhash_dedup(spark, sf_dir):
    found = near_components(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", hex_digits("fp").alias("fingerprint"), "component_id")


def op3_sharding(spark, sf_dir):
    return shard_report(_read(spark, sf_dir, "documents"), "doc_id")


def op4_line_dedup(spark, sf_dir):
    return line_report(_read(spark, sf_dir, "documents"))


def op5_mixing(spark, sf_dir):
    return mix_report(_read(spark, sf_dir, "documents"))


def op6_chat_format(spark, sf_dir):
    return conversations(link_quotes(_read(spark, sf_dir, "conversations")))


def op7_secret_scan(spark, sf_dir):
    return secret_report(_read(spark, sf_dir, "documents"))


def op8_language_id(spark, sf_dir):
    return identify(_read(spark, sf_dir, "documents"))


def op9_decontamination(spark, sf_dir):
    return edit_hits(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op10_exact_dedup(spark, sf_dir):
    return exact_groups(_read(spark, sf_dir, "documents"))


def queries():
    own = (
        op1_url_filter,
        op2_simhash_dedup,
        op3_sharding,
        op4_line_dedup,
        op5_mixing,
        op6_chat_format,
        op7_secret_scan,
        op8_language_id,
        op9_decontamination,
        op10_exact_dedup,
    )
    return {f.__name__: f for f in own}


def oracle_sql():
    return {
        "op1_url_filter": url_sql(),
        "op4_line_dedup": line_sql(),
        "op5_mixing": mix_sql(),
        "op7_secret_scan": secret_sql(),
        "op10_exact_dedup": exact_sql(),
    }
