"""Runs of the first layout: a directory for each pool with its tables as CSV, wide by horizon or group."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.files import Files
from tessera.plans.store import SAFE

#: What the columns of a wide table are, by how its name begins: the axis and the value.
WIDE = (("daily_ic", "horizon", "ic"), ("style_neutralized_ic", "horizon", "ic"), ("style_industry_neutralized_ic", "horizon", "ic"), ("daily_long_short", "horizon", "spread"), ("daily_group_membership_change", "group", "turnover"), ("factor_style_exposure_corr", "style", "corr"))


class LegacyResult:
    def __init__(self, spark: SparkSession, run_dir: str) -> None:
        self.spark, self.run_dir, self.files = spark, run_dir.rstrip("/"), Files(spark)

    @property
    def available_pools(self) -> list[str]:
        return [p for p in self.files.names(self.run_dir) if self.files.exists(f"{self.run_dir}/{p}/tables")]

    def available_tables(self, pool: str = "all") -> list[str]:
        return [n.removesuffix(".csv") for n in self.files.names(f"{self.run_dir}/{pool}/tables") if n.endswith(".csv")]

    def read_table(self, name: str, pool: str = "all") -> DataFrame:
        """A table in the long form that the operators take; others as they stand. Numbers are doubles."""
        if not SAFE.match(name) or not SAFE.match(pool):
            raise ValueError(f"not a table: {pool}/{name}")
        raw = self.spark.read.option("header", True).csv(f"{self.run_dir}/{pool}/tables/{name}.csv")
        first = raw.columns[0]
        raw = raw.withColumnRenamed(first, "trade_date") if first in ("_c0", "date") else raw
        text = {"horizon", "leg", "exposure", "industry", "series", "style", "window", "hac_status", "not_applicable_reason"}
        kind = lambda c: F.to_date(F.col(c).try_cast("timestamp")) if c in ("trade_date", "end_date", "start_date") else F.col(c) if c in text else F.col(c).try_cast("int") if c in ("group", "year") else F.col(f"`{c}`").try_cast("double")
        rows = raw.select(*[kind(c).alias(c) for c in raw.columns])
        wide = next(((axis, value) for start, axis, value in WIDE if name.startswith(start) and "_stats" not in name and "_summary" not in name), None)
        if wide is None or wide[0] in rows.columns:
            return rows
        axis, value = wide
        labels = [c for c in rows.columns if c != "trade_date"]
        short = F.regexp_replace(axis, "^(ic_|long_short_)", "") if axis == "horizon" else F.regexp_replace(axis, "^G", "").cast("int") if axis == "group" else F.col(axis)
        return rows.unpivot(["trade_date"], labels, axis, value).withColumn(axis, short)
