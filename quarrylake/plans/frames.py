"""The marts and the star over a directory of landed tables, built lazily."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from quarrylake.functions.staging import stage
from quarrylake.operators import forecast, marts, medallion, star
from quarrylake.plans import operations


class Frames:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    @cached_property
    def bronze(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/sample_machine_events.parquet")

    @cached_property
    def assignments(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/machine_assignments.parquet")

    @cached_property
    def silver(self) -> DataFrame:
        return medallion.silver(self.bronze)

    @cached_property
    def slim(self) -> DataFrame:
        """Trusted events with the columns that marts are made of."""
        return medallion.silver(self.bronze, (*marts.SOURCE,))

    @cached_property
    def days(self) -> DataFrame:
        return marts.machine_days(self.slim)

    @cached_property
    def uptime(self) -> DataFrame:
        return marts.machine_uptime(self.slim)

    @cached_property
    def failures(self) -> DataFrame:
        return marts.failure_events(self.slim)

    @cached_property
    def costs(self) -> DataFrame:
        return marts.maintenance_costs(self.slim)

    @cached_property
    def parts(self) -> DataFrame:
        return marts.parts_usage(self.slim)

    @cached_property
    def summary(self) -> DataFrame:
        return marts.asset_summary(self.days)

    @cached_property
    def staged_slim(self) -> DataFrame:
        """Trusted events, computed once: both marts and the quality checks read them."""
        return stage(self.slim)

    @cached_property
    def staged(self) -> tuple[DataFrame, DataFrame]:
        """The uptime and failure marts, computed once: the star reads them many times."""
        return stage(marts.machine_uptime(self.staged_slim)), stage(marts.failure_events(self.staged_slim))

    @cached_property
    def star(self) -> star.Star:
        return star.build_star(*self.staged)

    @cached_property
    def daily(self) -> DataFrame:
        return forecast.daily_actuals(self.uptime)

    @cached_property
    def quality_history(self) -> DataFrame:
        return operations.run_history(operations.landing_checks(self.bronze))

    @cached_property
    def manifest(self) -> DataFrame:
        return operations.landing_manifest(self.bronze)
