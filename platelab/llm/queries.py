"""The registered queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, fill_middle, kmeans_tree, knn_quality, licenses, mixing, quality_rules, recurrent_lm, repeats, sentencepiece_bpe, simhash, spelling, token_counts
from .common import read


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.round_trip(read(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


def op5_recurrent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recurrent_lm.score(read(spark, sf_dir, "documents"))


def op6_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeats(read(spark, sf_dir, "documents"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn_quality.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans_tree.search(read(spark, sf_dir, "embeddings"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(read(spark, sf_dir, "documents"))


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(read(spark, sf_dir, "documents"))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(read(spark, sf_dir, "documents"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_token_counts": op3_token_counts,
    "op4_mixing": op4_mixing,
    "op5_recurrent_lm": op5_recurrent_lm,
    "op6_suffix_array": op6_suffix_array,
    "op7_license_scan": op7_license_scan,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_nearest_neighbours": op9_nearest_neighbours,
    "op10_quality_rules": op10_quality_rules,
    "op11_byte_bpe": op11_byte_bpe,
    "op12_fill_middle": op12_fill_middle,
    "op13_spelling": op13_spelling,
}
ORACLES: dict[str, str] = {
    "op4_mixing": mixing.ORACLE_SQL,
    "op7_license_scan": licenses.ORACLE_SQL,
    "op10_quality_rules": quality_rules.ORACLE_SQL,
    "op12_fill_middle": fill_middle.ORACLE_SQL,
    "op13_spelling": spelling.ORACLE_SQL,
}
