"""The registered queries of this subpackage: (spark, sf_dir) -> DataFrame, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chunking, decontaminate, language, licenses, mixing, quality, repairs, simhash, suffixes, tokens, tries, urls, warc
from .session import scratch, table


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.dedup_suffixes(table(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), urls.rules_frame(spark))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.new_folder(scratch(spark))
    warc.write_warc(table(spark, sf_dir, "pages"), folder).agg(F.sum("records")).collect()
    return warc.page_records(warc.read_warc(spark, folder))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), target_entropy=mixing.TARGET_ENTROPY)


def op5_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.dedup_substrings(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    trees = language.fit(docs.where(~held_out))
    found = language.identify(docs, trees)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "bits_per_byte")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = tokens.new_folder(scratch(spark))
    tokens.write_tokens(table(spark, sf_dir, "documents"), folder, tokens.public_vocabulary()).agg(F.sum("ids")).collect()
    return tokens.token_digests(tokens.read_tokens(spark, folder))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tries.conversation_trie(table(spark, sf_dir, "conversations"))


def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repairs.conversation_repairs(table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_url_filter": op2_url_filter,
    "op3_warc": op3_warc,
    "op4_mixing": op4_mixing,
    "op5_chunk_dedup": op5_chunk_dedup,
    "op6_quality": op6_quality,
    "op7_language": op7_language,
    "op8_simhash": op8_simhash,
    "op9_licenses": op9_licenses,
    "op10_decontamination": op10_decontamination,
    "op11_token_ids": op11_token_ids,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_structure_repair": op13_structure_repair,
}

ORACLES = {
    "op2_url_filter": urls.ORACLE_SQL,
    "op3_warc": warc.ORACLE_SQL,
    "op4_mixing": mixing.ORACLE_SQL,
    "op9_licenses": licenses.oracle_sql(),
    "op12_conversation_trie": tries.ORACLE_SQL,
}
