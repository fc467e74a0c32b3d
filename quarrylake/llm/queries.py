"""Queries over documents, each through its problem's operator, with production parameters on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylake.llm import bpe, langid, packing


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_ids(_documents(spark, sf_dir))


def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.containers(bpe.token_counts(_documents(spark, sf_dir)))


def p10_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _documents(spark, sf_dir)
    identifier = langid.fit(spark.read.parquet(f"{sf_dir}/language_samples.parquet"), documents)
    return langid.identify(documents, identifier).drop("label")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _documents(spark, sf_dir)
    identifier = langid.fit(spark.read.parquet(f"{sf_dir}/language_samples.parquet"), documents)
    lines = langid.identify(documents, identifier).where("line_no is not null and lang is not null")
    return lines.where(~F.coalesce(langid.stated(F.col("label")) == F.col("lang"), F.lit(False))).select("doc_id", "line_no", "lang")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p8_ids, p9_containers, p10_languages, p10_found)}
SQL: dict[str, str] = {}
