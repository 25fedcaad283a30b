"""The panel views that the registered queries run over: suppliers by month of the order tables, users by day of events.

Each is one aggregate of its fact table, with the columns that it needs and no others.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: The panels held, by application and folder.
_HELD: dict[tuple[str, str], DataFrame] = {}


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel of monthly cells, aggregated from its fact table once an application and held on the executors."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _HELD:
        _HELD[key] = monthly_cells(spark, sf_dir).persist(StorageLevel.MEMORY_AND_DISK)
    return _HELD[key]


def monthly_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trade_date (month), symbol (supplier), prices, candidate factors f1..f4, styles size and weight, flags."""
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    price, n = F.sum("l_extendedprice") / F.sum("l_quantity"), F.count("*")
    return (
        read(spark, sf_dir, "lineitem")
        .groupBy(F.trunc("l_shipdate", "month").alias("trade_date"), "l_suppkey")  # its text is made of each cell, not of each line
        .agg(
            F.round(price, 6).alias("open_price"), F.round(F.max(unit), 6).alias("high_price"), F.round(F.min(unit), 6).alias("low_price"),
            F.round(price * 1.3, 6).alias("limit_up_price"), F.round(price * 0.7, 6).alias("limit_down_price"),
            F.when(F.max("l_discount") < 0.06, 1.0).otherwise(0.0).alias("is_st"), F.when(F.sum("l_quantity") < 60, 1.0).otherwise(0.0).alias("is_suspended"),
            F.round(F.avg("l_discount"), 6).alias("f1"), F.round(F.avg("l_tax"), 6).alias("f2"), F.sum("l_quantity").alias("f3"), n.cast("double").alias("f4"),
            F.round(F.ln(F.sum("l_extendedprice")), 6).alias("size"), F.round(F.avg("l_quantity"), 6).alias("weight"),
        )
        .withColumn("l_suppkey", F.col("l_suppkey").cast("string")).withColumnRenamed("l_suppkey", "symbol")
    )


def factor(rows: DataFrame, name: str = "f1") -> DataFrame:
    return rows.select("trade_date", "symbol", F.col(name).alias("value"))


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, region, balance."""
    s = read(spark, sf_dir, "supplier").join(read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    s = s.join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return s.select(F.col("s_suppkey").cast("string").alias("symbol"), F.col("r_name").alias("region"), F.col("s_acctbal").alias("balance"))


def risk(rows: DataFrame, who: DataFrame) -> DataFrame:
    """Styles size, weight and balance; the region as the one industry."""
    return rows.select("trade_date", "symbol", "size", "weight").join(who, "symbol").select("trade_date", "symbol", "size", "weight", "balance", F.array("region").alias("industries"))


def pool(rows: DataFrame, who: DataFrame) -> DataFrame:
    """The months of suppliers with a balance above zero."""
    return rows.select("trade_date", "symbol").join(who.where("balance > 0").select("symbol"), "symbol", "left_semi")


def book(rows: DataFrame) -> DataFrame:
    each = F.array(*[F.struct(F.lit(f).alias("factor_id"), F.col(f).alias("value")) for f in ("f2", "f3", "f4")])
    return rows.select("trade_date", "symbol", F.explode(each).alias("_b")).select("trade_date", "symbol", "_b.factor_id", "_b.value")


def user_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trade_date, symbol (user), value: the mean event value of a user's day."""
    e = read(spark, sf_dir, "events")
    return e.groupBy(F.to_date("ts").alias("trade_date"), F.col("user_id").cast("string").alias("symbol")).agg(F.round(F.avg("value"), 6).alias("value"))
