"""The registered queries of this subpackage and the SQL that states them, where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skeinlake.llm import cotrain, licenses, lm, mixing, ogg, pieces, simhash, spotsigs, suffixes, token_counts
from skeinlake.llm.common import read_table


def op1_cotrain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotrain.query(spark, sf_dir)


def op2_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.features(ogg.store_texts(read_table(spark, sf_dir, "documents")))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.query(spark, sf_dir)


def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(read_table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.query(spark, sf_dir)


def op6_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.query(spark, sf_dir)


def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.query(spark, sf_dir)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read_table(spark, sf_dir, "documents"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.query(spark, sf_dir)


def op10_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.query(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_cotrain": op1_cotrain,
    "op2_ogg": op2_ogg,
    "op3_mixing": op3_mixing,
    "op4_pieces": op4_pieces,
    "op5_simhash": op5_simhash,
    "op6_suffixes": op6_suffixes,
    "op7_lm": op7_lm,
    "op8_token_counts": op8_token_counts,
    "op9_licenses": op9_licenses,
    "op10_spotsigs": op10_spotsigs,
}

ORACLE_SQL: dict[str, str] = {
    "op3_mixing": mixing.oracle(),
    "op6_suffixes": suffixes.oracle(),
    "op9_licenses": licenses.oracle(),
}
