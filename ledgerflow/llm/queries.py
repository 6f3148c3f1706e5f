"""The queries of this subpackage, one for each operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import binary_out, collocations, decontam, html_text, near_dup, packing, prefix_trie, quality, sharding, token_scan, toxicity, url_rules, warc
from .common import table

NEAR_SHINGLE, NEAR_PERCENT = 4, 80
#: Sequence length and end id of the packer; end id of the packed files; end id of the flat files.
SEQUENCE, PACK_END = 2048, 0
BYTE_END = 2
WORD_END = 49407
SHARDS = 40
#: Payload bytes of a shard of archives, and the compressed size at which its files are rolled.
SHARD_BYTES, ARCHIVE_BYTES = 8 << 20, 1 << 20


def tokenizer_file(name: str) -> str:
    """Where the public vocabulary file is; the operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages"), file_bytes=ARCHIVE_BYTES, shard_bytes=SHARD_BYTES)


def op3_grouping_ga(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), False, PACK_END, SEQUENCE)


def op4_isolation_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_scan.token_counts(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), False, WORD_END)
    return found.select("doc_id", "n_tokens")


def op6_association_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"), doc=url_rules.document_of(F.col("url")))


def op7_max_subsequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(table(spark, sf_dir, "pages"))


def op8_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), shingle=NEAR_SHINGLE, percent=NEAR_PERCENT)


def op9_bit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary_out.packed_documents(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), True, BYTE_END)


def op10_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.placed(table(spark, sf_dir, "documents"), SHARDS)


def op11_setm_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))


def op13_subword_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_winnowing, op2_warc, op3_grouping_ga, op4_isolation_forest, op5_separator_scan, op6_association_rules, op7_max_subsequence, op8_superminhash, op9_bit_packing, op10_virtual_slots, op11_setm_collocations, op12_prefix_trie, op13_subword_toxicity)}


def oracle_sql() -> dict[str, str]:
    return {"op1_winnowing": decontam.ORACLE_SQL, "op8_superminhash": near_dup.ORACLE_SQL, "op11_setm_collocations": collocations.ORACLE_SQL, "op12_prefix_trie": prefix_trie.ORACLE_SQL}
