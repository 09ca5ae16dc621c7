"""The queries opN_<name> over the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from keyloom.llm import jpeg, licences, mixing, neighbours, packing, pii, repeats, secrets, simhash, toxicity
from keyloom.llm.common import table


def op1_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.without_repeats(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents"))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jpeg.media(table(spark, sf_dir, "documents"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(table(spark, sf_dir, "documents"))


def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.licences(table(spark, sf_dir, "pages"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


QUERIES = {"op1_repeats": op1_repeats, "op2_toxicity": op2_toxicity, "op3_simhash": op3_simhash, "op4_neighbours": op4_neighbours, "op5_mixing": op5_mixing, "op6_media": op6_media, "op7_secrets": op7_secrets, "op8_licences": op8_licences, "op9_packing": op9_packing, "op10_pii": op10_pii}
ORACLES = {"op5_mixing": mixing.sql(), "op8_licences": licences.sql()}
