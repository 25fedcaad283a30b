"""The run store: base tables as Parquet by pool, a manifest, and a pointer to the latest run.

A run is written to a staging directory and moved into place under its factor's lock; from then on it doesn't
change. Only base tables are stored; all others are made anew from them.
"""

from __future__ import annotations

import re
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.timeseries import between
from tessera.plans.files import Files

RESULT_VERSION, LATEST_VERSION = "2.0", "1.0"
#: Fixed names of base tables, and beginnings of such names.
BASE_TABLES = ("data_quality", "daily_group_returns", "within_industry_daily_group_returns", "group_style_exposure_daily", "group_industry_exposure_daily", "daily_group_membership_change")
BASE_PREFIXES = ("daily_ic_", "style_neutralized_ic_", "style_industry_neutralized_ic_", "factor_style_exposure_corr_")
NOT_BASE = re.compile(r"_(summary|stats)(_|$)")
INDEX = ("trade_date", "horizon", "group", "leg", "exposure", "industry", "style")
SAFE = re.compile(r"^[A-Za-z0-9_.-]+$")


def is_base(name: str) -> bool:
    return name in BASE_TABLES or (name.startswith(BASE_PREFIXES) and not NOT_BASE.search(name))


@dataclass(frozen=True)
class RunPaths:
    factor_dir: str
    run_id: str
    staging: str
    final: str


def prepare(files: Files, output_root: str, factor_name: str, run_id: str, layout: str = "latest_runs") -> RunPaths:
    factor_dir = f"{output_root.rstrip('/')}/{factor_name}"
    final = f"{factor_dir}/runs/{run_id}" if layout == "latest_runs" else f"{factor_dir}/{run_id}"
    if files.exists(final):
        raise FileExistsError(final)
    staging = f"{factor_dir}/.staging/{run_id}"
    files.make(staging)
    return RunPaths(factor_dir, run_id, staging, final)


def write_tables(spark: SparkSession, run_dir: str, tables: dict[str, dict[str, DataFrame]], sections: dict[str, list[str]] | None = None, compression: str = "zstd") -> dict:
    """Writes tables, of each name a frame by pool, and returns their manifest."""
    def write(name: str, by_pool: dict[str, DataFrame]) -> dict:
        schemas = {tuple(c for c in df.columns if c in INDEX) for df in by_pool.values()}
        if len(schemas) > 1:
            raise ValueError(f"{name}: pools have different keys")
        if any("pool" in df.columns for df in by_pool.values()):
            raise ValueError(f"{name}: 'pool' is the store's own column")
        # a base table has a row for a date and a few keys, however many symbols there are: one file a pool, without a shuffle
        whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (df.coalesce(1).select(F.lit(p).alias("pool"), "*") for p, df in by_pool.items()))
        path = f"{run_dir}/tables/{name}"
        whole.write.option("compression", compression).partitionBy("pool").parquet(path)
        back = spark.read.schema(whole.schema).parquet(path).coalesce(1)
        dated = "trade_date" in whole.columns
        facts = back.agg(F.count("*"), *([F.min("trade_date"), F.max("trade_date")] if dated else [])).first()
        return {
            "path": f"tables/{name}", "rows": facts[0], "columns": whole.columns, "index_columns": list(schemas.pop()), "data_columns": [c for c in whole.columns if c not in (*INDEX, "pool")],
            "pools": list(by_pool), "date_range": [str(facts[1]), str(facts[2])] if dated and facts[1] is not None else None, "source_sections": (sections or {}).get(name, []), "compression": compression,
            "schema": whole.schema.jsonValue(),
        }

    base = {name: by_pool for name, by_pool in tables.items() if is_base(name)}
    with ThreadPoolExecutor(4) as workers:
        entries = dict(zip(base, workers.map(write, base, base.values()), strict=True))
    return {"schema_version": RESULT_VERSION, "tables": entries}


def read_table(spark: SparkSession, run_dir: str, entry: dict, pool: str, start=None, end=None) -> DataFrame:
    """A pool's rows of a stored table in a closed date range; both are pushed down to the scan. One partition, as it is
    one file, so that what is made along the dates needs no shuffle."""
    from pyspark.sql.types import StructType

    if ".." in entry["path"].split("/") or entry["path"].startswith("/"):
        raise ValueError(f"path outside the run: {entry['path']}")
    if pool not in entry["pools"]:
        raise KeyError(pool)
    df = spark.read.schema(StructType.fromJson(entry["schema"])).parquet(f"{run_dir}/{entry['path']}").where(F.col("pool") == pool).drop("pool")
    return (between(df, start, end) if "trade_date" in df.columns else df).coalesce(1)


def publish(files: Files, paths: RunPaths, payload: dict | None = None, timeout: float = 30.0) -> str:
    with files.lock(f"{paths.factor_dir}/.publish.lock", timeout):
        if files.exists(paths.final):
            raise FileExistsError(paths.final)
        files.make(paths.final.rpartition("/")[0])
        files.move(paths.staging, paths.final)
        relative = paths.final.removeprefix(f"{paths.factor_dir}/")
        files.write_json(f"{paths.factor_dir}/latest.json", {"schema_version": LATEST_VERSION, "run_id": paths.run_id, "path": relative} | (payload or {}))
    return paths.final


def resolve(files: Files, output_root: str, factor_name: str, run: str = "latest") -> str:
    """The directory of a run: the latest, or one named."""
    factor_dir = f"{output_root.rstrip('/')}/{factor_name}"
    if run != "latest":
        if not SAFE.match(run):
            raise ValueError(f"not a run id: {run}")
        found = next((p for p in (f"{factor_dir}/runs/{run}", f"{factor_dir}/{run}") if files.exists(p)), None)
        if found is None:
            raise FileNotFoundError(f"{factor_dir}/runs/{run}")
        return found
    if not files.exists(f"{factor_dir}/latest.json"):
        if files.exists(f"{factor_dir}/latest"):
            return f"{factor_dir}/latest"
        raise FileNotFoundError(f"{factor_dir}/latest.json")
    latest = files.read_json(f"{factor_dir}/latest.json")
    if latest.get("schema_version") != LATEST_VERSION:
        raise ValueError(f"latest.json has version {latest.get('schema_version')}")
    if latest["path"].startswith("/") or ".." in latest["path"].split("/"):
        raise ValueError(f"path outside the factor's directory: {latest['path']}")
    return f"{factor_dir}/{latest['path']}"
