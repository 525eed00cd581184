"""Filtered scans, per-day files, and writes that skip unchanged months."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.expr import finite, to_double
from .tables import SchemaError, require_columns


def until_month(df: DataFrame, year: int, month: int) -> DataFrame:
    """Rows of partitions up to a month: a predicate on ``year`` and ``month``
    alone, so whole folders are skipped. Rows of the last month still need the
    bound of ``tables.bounded``. Partitions without a number are kept."""
    y, m = F.col("year"), F.col("month")
    return df.where((y < year) | ((y == year) & (m <= month)) | y.isNull() | m.isNull())


def filtered(df: DataFrame, columns: list[str], column: str | None = None, value=None) -> DataFrame:
    """Columns of a foreign table, of the rows where ``column`` has the value.
    The filter column need not be among the columns; both reach the scan."""
    require_columns(df, [*columns, *([column] if column else [])])
    return (df.where(F.col(column) == F.lit(value)) if column else df).select(*columns)


def finite_rows(df: DataFrame, numbers: list[str], split: str | None = None) -> DataFrame:
    """Rows of a split (any case) whose numbers, as doubles, are all finite;
    texts that are no number count as missing."""
    require_columns(df, [*numbers, *(["split"] if split else [])])
    kinds = dict(df.dtypes)
    d = df.withColumns({c: to_double(F.col(c)) if kinds[c] == "string" else F.col(c).cast("double") for c in numbers})
    for c in numbers:
        d = d.where(finite(F.col(c)))
    return d.where(F.lower(F.col("split")) == split.lower()) if split else d


def feature_list(base: list[str], numeric: list[str], manifest: dict[str, dict], prefix: str = "") -> list[str]:
    """Names of all features: the base ones, the prefixed numeric ones, and the
    one-hot columns that the encoding manifest lists. Raises on a repeated name."""
    out = [*base, *(prefix + c for c in numeric), *(c for entry in manifest.values() for c in entry["encoded_columns"])]
    twice = sorted({c for c in out if out.count(c) > 1})
    if twice:
        raise SchemaError(f"features named twice: {twice}")
    return out


def write_daily(df: DataFrame, root: str, day: str = "trading_date") -> None:
    """One folder a day; only days at hand are replaced. Rows are dealt by day and
    in balanced parts, so a large day gets several files."""
    df.hint("rebalance", F.col(day)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(root)


def month_prints(df: DataFrame, months: list[str]) -> DataFrame:
    """Row count and order-independent hash of each month."""
    h = F.xxhash64(*[F.col(c) for c in sorted(df.columns)]).cast("decimal(38,0)")
    return df.groupBy(*months).agg(F.count("*").alias("n_rows"), F.sum(h).cast("string").alias("hash"))


def write_changed(spark: SparkSession, df: DataFrame, root: str, manifest: str, months: tuple[str, ...] = ("symbol", "year", "month")) -> int:
    """Write the months whose fingerprint differs from the one in the manifest;
    the number of months written. The manifest is appended behind the data, so a
    job lost in between writes the same months again. Unchanged data write
    nothing. The last entry of a month counts."""
    keys = list(months)
    prints = month_prints(df, keys)
    path = spark._jvm.org.apache.hadoop.fs.Path(manifest)
    changed = prints
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        known = spark.read.parquet(manifest)
        last = known.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("written_at")))).where("_k = 1")
        same = prints["n_rows"] == last["n_rows"]
        for c in [*keys, "hash"]:
            same = same & prints[c].eqNullSafe(last[c])
        changed = prints.join(last, same, "left_anti")
    # a row a month: the list of what to write is fixed before anything is written
    rows = changed.collect()
    if not rows:
        return 0
    changed = spark.createDataFrame(rows, prints.schema)
    k = [changed[c].alias(f"_{c}") for c in keys]
    hit = F.lit(True)
    for c in keys:
        hit = hit & F.col(c).eqNullSafe(F.col(f"_{c}"))
    part = df.join(F.broadcast(changed.select(*k)), hit, "left_semi")
    part.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(root)
    changed.withColumn("written_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(manifest)
    return len(rows)
