"""The queries of this package: one per operator, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import addquant, huffman, hyperminhash, linkrank, media, milquality, mixing, packing, pii, prefixtrie, sharding, tilelinks, whitening
from .common import table


def op1_iso_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.store_texts(table(spark, sf_dir, "documents"))


def op2_additive_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return addquant.neighbours(table(spark, sf_dir, "embeddings"))


def op3_attention_mil_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return milquality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_host_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkrank.judge(table(spark, sf_dir, "pages"), rounds=None).drop("trust", "distrust")


def op5_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperminhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_mix_to_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_digest(table(spark, sf_dir, "documents"))


def op7_huffman_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return huffman.token_files(table(spark, sf_dir, "documents"))


def op8_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


def op9_minimum_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op11_bit_sliced_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_centroid_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.prefix_nodes(table(spark, sf_dir, "conversations"))


def op13_int8_tile_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tilelinks.near_duplicates(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_iso_media": op1_iso_media,
        "op2_additive_quantisation": op2_additive_quantisation,
        "op3_attention_mil_quality": op3_attention_mil_quality,
        "op4_host_trust": op4_host_trust,
        "op5_hyperminhash": op5_hyperminhash,
        "op6_mix_to_weights": op6_mix_to_weights,
        "op7_huffman_token_files": op7_huffman_token_files,
        "op8_weak_supervision_pii": op8_weak_supervision_pii,
        "op9_minimum_bin_slack": op9_minimum_bin_slack,
        "op10_rendezvous_shards": op10_rendezvous_shards,
        "op11_bit_sliced_whitening": op11_bit_sliced_whitening,
        "op12_centroid_prefix_trie": op12_centroid_prefix_trie,
        "op13_int8_tile_links": op13_int8_tile_links,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_host_trust": linkrank.ORACLE, "op6_mix_to_weights": mixing.ORACLE, "op12_centroid_prefix_trie": prefixtrie.ORACLE, "op13_int8_tile_links": tilelinks.ORACLE}
