"""Factor files: found by name, read in four layouts, and checked before use."""

from __future__ import annotations

import os
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import expr
from tessera.plans.files import Files
from tessera.sources.common import SourceError, count_where, pick, reject_duplicates

DATES, SYMBOLS, VALUES = ("trade_date", "date"), ("symbol", "asset"), ("factor_value", "factor", "value")
SUFFIXES = (".parquet", ".h5", ".csv")


def resolve_path(spark: SparkSession, data_root: str, factor_name: str, factor_path: str | None = None, suffixes: Sequence[str] = SUFFIXES) -> str:
    """The path given, or the first of <root>/factor_<name>/factor_<name><suffix> that there is."""
    files = Files(spark)
    tried = [factor_path] if factor_path else [f"{data_root.rstrip('/')}/factor_{factor_name}/factor_{factor_name}{s}" for s in suffixes]
    found = next((p for p in tried if files.exists(p)), None)
    if found is None:
        raise FileNotFoundError(f"no factor file: {', '.join(tried)}")
    return found


def is_long(columns: Sequence[str]) -> bool:
    return pick(columns, DATES) is not None and pick(columns, SYMBOLS) is not None


def to_long(raw: DataFrame, value_column: str | None = None, values: Sequence[str] = VALUES, out: str = "value") -> DataFrame:
    """Date, symbol and value as they are, from a long table or from one with a column for each symbol."""
    date = pick(raw.columns, DATES)
    if date is None:
        raise SourceError(f"no date column among {raw.columns[:10]}")
    if is_long(raw.columns):
        value = value_column or pick(raw.columns, values)
        if value is None or value not in raw.columns:
            raise SourceError(f"no value column: {value_column or ', '.join(values)}")
        return raw.select(F.col(date).alias("trade_date"), F.col(pick(raw.columns, SYMBOLS)).cast("string").alias("symbol"), F.col(value).alias(out))
    names = [c for c in raw.columns if c != date]
    if not names:
        raise SourceError("no symbol columns")
    text = any(kind == "string" for c, kind in raw.dtypes if c != date)
    rows = raw.select(F.col(date).alias("trade_date"), *[F.col(f"`{c}`").cast("string" if text else "double").alias(c) for c in names])
    return rows.unpivot(["trade_date"], [f"`{c}`" for c in names], "symbol", out)


def normalize(raw: DataFrame, value_column: str | None = None) -> DataFrame:
    """trade_date date, symbol, value double. Errors: dates that aren't midnights, values that aren't numbers, repeated keys."""
    rows = to_long(raw, value_column)
    kind = dict(rows.dtypes)["trade_date"]
    if kind not in ("date", "timestamp", "timestamp_ntz", "string"):
        raise SourceError(f"dates are of type {kind}")
    stamp = F.col("trade_date") if kind != "string" else F.try_to_timestamp("trade_date")
    rows = rows.select(stamp.cast("timestamp").alias("_at"), "symbol", "value", F.col("value").try_cast("double").alias("_v"))
    found = count_where(rows, dates=F.col("_at").isNull(), intraday=F.col("_at") != F.date_trunc("day", "_at"), symbols=F.col("symbol").isNull(), values=F.col("_v").isNull() & F.col("value").isNotNull() & (F.trim(F.col("value").cast("string")) != ""))
    for what, n in found.items():
        if n:
            raise SourceError({"dates": "rows have no readable date", "intraday": "rows have a time of day", "symbols": "rows have no symbol", "values": "values aren't numbers"}[what] + f": {n}")
    rows = rows.select(F.to_date("_at").alias("trade_date"), "symbol", expr.clean(F.col("_v")).alias("value"))
    return reject_duplicates(rows, ["trade_date", "symbol"], "factor")


def load(spark: SparkSession, path: str, value_column: str | None = None, h5_key: str | None = None) -> DataFrame:
    """A factor from CSV, a Parquet file, a directory of Parquet files, or HDF5 where pandas can read it."""
    suffix = os.path.splitext(path.rstrip("/"))[1].lower()
    if suffix == ".csv":
        return normalize(spark.read.option("header", True).csv(path), value_column)
    if suffix in (".h5", ".hdf5", ".hdf"):
        return normalize(read_hdf(spark, path, h5_key), value_column)
    if suffix not in ("", ".parquet"):
        raise SourceError(f"no reader for {suffix}: {path}")
    names = [n for n in Files(spark).names(path) if n.endswith(".parquet")]
    if suffix == ".parquet" and path.rstrip("/").rpartition("/")[2] in names or len(names) <= 1:
        return normalize(read_parquet(spark, path), value_column)
    return load_parts(spark, path, names, value_column)


def load_parts(spark: SparkSession, path: str, names: Sequence[str], value_column: str | None = None) -> DataFrame:
    """The files of a directory, each of its own dates; their symbols are united. A date in two files is an error."""
    parts = [to_long(read_parquet(spark, f"{path}/{n}"), value_column).withColumn("_file", F.lit(n)) for n in sorted(names)]
    rows = reduce(lambda a, b: a.unionByName(b), [p.withColumn("value", F.col("value").cast("string")) for p in parts])
    twice = rows.groupBy("trade_date").agg(F.countDistinct("_file").alias("n")).where("n > 1").orderBy("trade_date").limit(10).collect()
    if twice:
        raise SourceError(f"dates in several files: {', '.join(str(r[0]) for r in twice)}")
    return normalize(rows.drop("_file"))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Parquet whose dates may be counts of nanoseconds, as other writers make them."""
    spark.conf.set("spark.sql.legacy.parquet.nanosAsLong", "true")
    raw = spark.read.parquet(path)
    date = pick(raw.columns, DATES)
    if date and dict(raw.dtypes)[date] == "bigint" and (raw.agg(F.min(F.abs(date))).first()[0] or 0) > 10**15:
        raw = raw.withColumn(date, F.timestamp_micros(F.floor(F.col(date) / 1000).cast("long")))
    return raw


def read_hdf(spark: SparkSession, path: str, key: str | None) -> DataFrame:
    """An HDF5 table by way of the driver; there is no distributed reader for the format."""
    try:
        import tables  # noqa: F401
    except ImportError as e:
        raise SourceError("HDF5 needs the PyTables package; convert the file to Parquet") from e
    import pandas as pd

    with pd.HDFStore(path, "r") as held:
        keys = held.keys()
        if key is None and len(keys) != 1:
            raise SourceError(f"several tables, name one: {keys}")
        frame = held[key or keys[0]]
    return spark.createDataFrame(frame.rename_axis(index=None).reset_index(names="trade_date") if "trade_date" not in frame.columns else frame)


def from_pandas(spark: SparkSession, frame) -> DataFrame:
    """A driver-side frame, wide (dates by symbols), with a two-level index, or long, as a Spark table."""
    import pandas as pd

    if isinstance(frame.index, pd.MultiIndex):
        frame = frame.reset_index()
    elif not is_long(frame.columns) and pick(list(map(str, frame.columns)), DATES) is None:
        if pd.api.types.is_numeric_dtype(frame.index):
            raise SourceError("the index holds numbers, not dates")
        frame = frame.rename_axis(index="trade_date").reset_index()
    names = [str(c) for c in frame.columns]
    if len(set(names)) < len(names):
        raise SourceError("two columns have the same name as text")
    return spark.createDataFrame(frame.set_axis(names, axis=1))
