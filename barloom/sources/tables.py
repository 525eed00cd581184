"""Scans and sinks of bar tables: CSV, hive-partitioned Parquet, sealed scans,
insert-only merges, fingerprints, manifests."""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.expr import finite, norm_key, split_list, to_double

RAW = ("datetime", "open", "high", "low", "close", "volume")
PAIR = ("wap", "bar_count")
#: Fixed order of the canonical columns.
CANONICAL = ("datetime", "calendar_date", "trading_date", "session", "open", "high", "low", "close", "volume", "wap", "bar_count", "symbol", "source_id", "is_observed", "is_imputed")


class SchemaError(ValueError):
    """A table lacks a column that its layer promises."""


class MergeConflict(ValueError):
    """Rows of equal key differ."""


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    gone = [c for c in columns if c not in df.columns]
    if gone:
        raise SchemaError(f"missing columns: {gone}")
    return df


def ordered_columns(columns: list[str], first: tuple[str, ...] = CANONICAL) -> list[str]:
    """Canonical columns first, the others by name."""
    return [c for c in first if c in columns] + sorted(c for c in columns if c not in first)


def read_bars_csv(spark: SparkSession, path: str, zone: str = "America/New_York") -> tuple[DataFrame, DataFrame]:
    """Scan raw bars and count what could not be read.

    Headers are trimmed and lower-cased; ``wap`` and ``bar_count`` come
    together or not at all. Times with an offset are instants, others wall time
    of the zone; both become UTC wall time (NTZ). Returns rows and one row of
    counters.
    """
    raw = spark.read.option("header", True).csv(path)
    raw = raw.toDF(*[c.strip().lower() for c in raw.columns])
    require_columns(raw, list(RAW))
    if len([c for c in PAIR if c in raw.columns]) == 1:
        raise SchemaError("wap and bar_count must come together")
    numbers = [c for c in (*RAW[1:], *PAIR) if c in raw.columns]
    return typed_bars(raw, numbers, zone)


def parse_time(c: Column, zone: str) -> Column:
    offset = c.rlike(r"(?:Z|[+-]\d{2}:?\d{2})$")
    instant = F.try_to_timestamp(c)
    utc = F.to_timestamp_ntz(F.date_format(instant, "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    wall = F.convert_timezone(F.lit(zone), F.lit("UTC"), F.when(~offset, instant.cast("timestamp_ntz")))
    return F.when(offset, utc).otherwise(wall)


def typed_bars(raw: DataFrame, numbers: list[str], zone: str) -> tuple[DataFrame, DataFrame]:
    """Text columns to typed ones, and one row of counters of what failed."""
    made = raw.withColumns({f"_{c}": to_double(F.col(c)) for c in numbers} | {"_at": parse_time(F.trim("datetime"), zone)})
    bad = made.agg(F.count("*").alias("n_rows"), F.count_if(F.col("_at").isNull()).alias("invalid_datetime"), *[F.count_if(F.col(f"_{c}").isNull() & F.col(c).isNotNull()).alias(f"invalid_{c}") for c in numbers])
    rows = made.select(F.col("_at").alias("datetime"), *[F.col(f"_{c}").alias(c) for c in numbers], *[c for c in raw.columns if c not in ("datetime", *numbers)])
    return rows, bad


def read_monthly(spark: SparkSession, root: str, symbol: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """Scan ``symbol=/year=/month=`` partitions; symbol and columns prune.
    Folders are checked first (``discover_monthly``)."""
    discover_monthly(spark, root)
    df = spark.read.parquet(root)
    if symbol is not None:
        df = df.where(F.col("symbol") == symbol.strip().lower())
    return df.select(*columns) if columns else df


def bounded(df: DataFrame, last_date=None, last_time=None, day: str = "trading_date", ts: str = "datetime", verify: bool = True) -> DataFrame:
    """Rows up to a date or a time, by predicates that reach the scan. With
    ``verify`` the largest values that come back are checked."""
    if last_date is not None:
        df = df.where(F.col(day) <= F.lit(last_date))
    if last_time is not None:
        df = df.where(F.col(ts) <= F.lit(last_time))
    if verify:
        # compared by the engine: a bound may be a column
        later = lambda c, last: F.max(c) > F.lit(last) if last is not None else F.lit(False)
        top = df.agg(later(day, last_date).alias("d"), later(ts, last_time).alias("t")).first()
        if top.d or top.t:
            raise SchemaError("a bounded scan returned later rows")
    return df


def sealed(df: DataFrame, allowed: tuple[str, ...] = ("train", "validation"), split: str = "split") -> DataFrame:
    """Scan that refuses sealed rows: the split column alone is read first, and
    anything but the allowed values, NULL included, raises."""
    seen = {r[0] for r in df.select(split).distinct().limit(len(allowed) + 2).collect()}
    if not seen <= set(allowed):
        raise SchemaError(f"the table holds sealed splits: {sorted(map(str, seen - set(allowed)))}")
    return df.where(F.col(split).isin(*allowed))


def lookup(table: DataFrame, **key) -> DataFrame:
    """The one metadata row of a key (trimmed, lower case), lists split."""
    for k, v in key.items():
        table = table.where(norm_key(F.col(k)) == v.strip().lower())
    if "coverage_sessions" in table.columns:
        table = table.withColumn("coverage_sessions", split_list(F.col("coverage_sessions")))
    rows = table.limit(2).collect()
    if len(rows) != 1:
        raise SchemaError(f"{key}: {'no' if not rows else 'more than one'} metadata row")
    return table


def canonical(bars: DataFrame, source_id: str) -> DataFrame:
    """Canonical frame of labelled observed bars."""
    d = bars.withColumns({"calendar_date": F.to_date("datetime"), "symbol": norm_key(F.col("symbol")), "source_id": F.lit(source_id.strip().lower()), "is_observed": F.lit(True), "is_imputed": F.lit(False)})
    require_columns(d, list(CANONICAL))
    return d.select(*ordered_columns(d.columns))


def canonical_checks(df: DataFrame) -> DataFrame:
    """Counters that must all be 0 in a canonical frame."""
    numbers = ("open", "high", "low", "close", "volume", "wap", "bar_count")
    missing = F.lit(False)
    for c in numbers:
        missing = missing | ~finite(F.col(c).cast("double"))
    both = df.agg(F.count_if(F.col("datetime").isNull()).alias("bad_datetime"), F.count_if(missing).alias("missing_numbers"), F.count_if(F.col("session") == "unknown").alias("unknown_session"), F.count_if(F.col("bar_count") != F.floor("bar_count")).alias("fractional_count"), F.count_if(F.col("is_observed") == F.col("is_imputed")).alias("bad_flags"), F.count_if(F.to_date("datetime") != F.col("calendar_date")).alias("bad_calendar_date"))
    return both.join(df.groupBy("datetime", "symbol").count().agg(F.count_if(F.col("count") > 1).alias("repeated_keys")))


def write_monthly(df: DataFrame, root: str, ts: str = "datetime", mode: str = "overwrite", zone: str = "America/New_York") -> None:
    """One directory a symbol and month of local time in ``zone`` (``ts`` is
    UTC), zstd; only months at hand are replaced."""
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), F.col(ts).cast("timestamp_ntz")) if df.schema[ts].dataType == T.TimestampNTZType() else F.convert_timezone(F.current_timezone(), F.lit(zone), F.col(ts).cast("timestamp_ntz"))
    d = df.withColumn("year", F.year(local)).withColumn("month", F.month(local))
    d.repartition("symbol", "year", "month").sortWithinPartitions("symbol", "year", "month", ts).write.mode(mode).option("compression", "zstd").option("partitionOverwriteMode", "dynamic").partitionBy("symbol", "year", "month").parquet(root)


#: A partition folder of the monthly tables.
MONTH_PATH = re.compile(r"symbol=([^/=]+)/year=(\d{4})/month=(\d{1,2})")


def discover_monthly(spark: SparkSession, root: str) -> list[tuple[str, int, int, str]]:
    """``symbol, year, month, path`` of every partition folder, in order, from
    listings alone. Raises on a folder that is no valid partition, on files
    outside of one, and on two folders that name the same one (``month=1`` and
    ``month=01``)."""
    jvm = spark._jvm
    base = jvm.org.apache.hadoop.fs.Path(root)
    fs = base.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    base = fs.makeQualified(base)
    found: dict[tuple[str, int, int], str] = {}

    def walk(path, parts: list[str]) -> None:
        for status in fs.listStatus(path):
            name = status.getPath().getName()
            if name[0] in "_.":
                continue
            here = [*parts, name]
            if not status.isDirectory():
                raise SchemaError(f"a file outside of a partition: {'/'.join(here)}")
            if len(here) < 3:
                walk(status.getPath(), here)
                continue
            m = MONTH_PATH.fullmatch("/".join(here))
            if not m or not 1 <= int(m[3]) <= 12:
                raise SchemaError(f"not a partition: {'/'.join(here)}")
            key = (m[1], int(m[2]), int(m[3]))
            if key in found:
                raise SchemaError(f"partition {key} is there twice: {found[key]}, {status.getPath()}")
            found[key] = status.getPath().toString()

    walk(base, [])
    return [(*k, p) for k, p in sorted(found.items())]


def fingerprint(df: DataFrame) -> DataFrame:
    """Row count and an order-independent hash of all columns by name."""
    h = F.xxhash64(*[F.col(c) for c in sorted(df.columns)]).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(h), F.lit(0)).cast("decimal(38,0)").cast("string").alias("hash"))


def frames_equal(left: DataFrame, right: DataFrame) -> bool:
    """Same columns and the same rows, repeats included."""
    if set(left.columns) != set(right.columns):
        return False
    r = right.select(*left.columns)
    return not left.exceptAll(r).limit(1).count() and not r.exceptAll(left).limit(1).count()


def _by_key(df: DataFrame, keys: list[str], rest: list[str], name: str) -> DataFrame:
    """One row a key (NULL is a value): the other columns, as text too, and
    whether rows of the key differ."""
    micros = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    text = F.to_json(F.struct(*rest), {"ignoreNullFields": "false", "timestampFormat": micros, "timestampNTZFormat": micros}) if rest else F.lit("")
    d = df.select(*[F.col(k).alias(f"{name}_{k}") for k in keys], F.struct(*rest, F.lit(1).alias("_")).alias("_row"), text.alias("_text"))
    return d.groupBy(*[f"{name}_{k}" for k in keys]).agg(F.first("_row").alias(f"{name}_row"), F.min("_text").alias(f"{name}_lo"), F.max("_text").alias(f"{name}_hi"))


def _compared(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Every incoming key once, with the row of the table if it knows the key,
    and ``state``: new, identical or conflict."""
    if set(existing.columns) != set(incoming.columns):
        raise SchemaError("columns of the two tables differ")
    rest = [c for c in existing.columns if c not in keys]
    i, e = _by_key(incoming, keys, rest, "i"), _by_key(existing, keys, rest, "e")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"i_{k}").eqNullSafe(F.col(f"e_{k}"))
    j = i.join(e, same, "left")
    differ = (F.col("i_lo") != F.col("i_hi")) | (F.col("e_lo") != F.col("e_hi")) | (F.col("e_lo") != F.col("i_lo"))
    return j.withColumn("state", F.when(F.coalesce(differ, F.col("i_lo") != F.col("i_hi")), "conflict").when(F.col("e_lo").isNull(), "new").otherwise("identical"))


def _new_rows(compared: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    return compared.where("state = 'new'").select(*[F.col(f"i_{c}" if c in keys else f"i_row.{c}").alias(c) for c in columns])


def _report(compared: DataFrame) -> DataFrame:
    of = lambda s: F.count_if(F.col("state") == s)
    return compared.agg(of("new").alias("new_rows"), of("identical").alias("identical"), of("conflict").alias("conflicts"))


def merge_insert(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Insert-only merge: ``(merged, report)``. New keys are added once, equal
    rows of a key (in the table, or repeated) are ignored, and the report counts
    conflicts: keys whose rows differ, on either side or between the two. NULLs
    are equal, in keys too."""
    compared = _compared(existing, incoming, keys)
    return existing.unionByName(_new_rows(compared, keys, existing.columns)), _report(compared)


def upsert(spark: SparkSession, root: str, incoming: DataFrame, keys: list[str], prune: list[str] | None = None) -> dict:
    """Insert-only merge into a Parquet table. Identical data writes nothing;
    a conflict raises, also among the incoming rows of a new table; new keys are
    appended, so a lost job leaves the old files as they were. ``prune`` names
    partition columns: only partitions that the incoming rows touch are read."""
    try:
        existing = spark.read.parquet(root)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        existing = spark.createDataFrame([], incoming.schema)
    columns = existing.columns
    if prune:
        # few distinct values: symbol and month of a batch
        existing = existing.join(F.broadcast(incoming.select(*prune).distinct()), prune, "left_semi")
    compared = _compared(existing, incoming.select(*columns), keys)
    row = _report(compared).first().asDict()
    if row["conflicts"]:
        raise MergeConflict(f"rows of {row['conflicts']} keys differ")
    if row["new_rows"]:
        new = _new_rows(compared, keys, columns).write.mode("append")
        (new.partitionBy(*prune) if prune else new).parquet(root)
    return row


def write_once(df: DataFrame, path: str) -> None:
    """Refuse to replace an artifact."""
    df.write.mode("errorifexists").parquet(path)


def append_manifest(spark: SparkSession, path: str, record: dict) -> None:
    spark.createDataFrame([(json.dumps(record, sort_keys=True),)], "value string").coalesce(1).write.mode("append").text(path)


def read_manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def signature(value) -> str:
    """SHA-256 of compact JSON with sorted keys."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def path_number(x: float) -> str:
    """A number as a path part: no trailing zeros, ``p`` for the point."""
    return re.sub(r"\.?0+$", "", f"{x:.6f}").replace(".", "p") or "0"


def artifact_path(root: str, **parts) -> str:
    return "/".join([root.rstrip("/"), *(f"{k}={v}" for k, v in parts.items())])


def coverage_start(instrument_start: Column, source_start: Column) -> Column:
    """The later of the two; a missing one does not count."""
    return F.greatest(instrument_start, source_start)


def floor_dates(df: DataFrame, start, floor: str = "2020-01-03", day: str = "trading_date") -> DataFrame:
    """Rows from a start date on, never before the common floor."""
    return df.where(F.col(day) >= F.greatest(F.lit(start).cast("date"), F.lit(floor).cast("date")))


def expand_jobs(groups: dict[str, list[str]], sessions: list[str], bar: str) -> list[tuple[str, str, str]]:
    """Jobs of a batch: every symbol of every group and session, once a dataset."""
    return list(dict.fromkeys((symbol.strip().lower(), bar, s) for symbols in groups.values() for symbol in symbols for s in sessions))


def horizon_columns(horizon: int, part: str = "all") -> list[str]:
    """Names of the target columns of a horizon: structural, outcome or all."""
    structural = [f"target_{c}_{horizon}m" for c in ("valid", "realized_at", "same_session", "same_trading_date", "invalid_reason")]
    outcome = [f"target_{c}_{horizon}m" for c in ("close", "simple_return", "log_return", "return_bps", "direction")]
    return {"structural": structural, "outcome": outcome, "all": structural + outcome}[part]


def flatten(config, prefix: str = "") -> dict:
    """Nested settings as dotted names."""
    if not isinstance(config, dict):
        return {prefix: config}
    out = {}
    for k, v in config.items():
        out |= flatten(v, f"{prefix}.{k}" if prefix else str(k))
    return out


def config_diff(left: dict, right: dict) -> dict:
    """Dotted names whose values differ, with both values."""
    a, b = flatten(left), flatten(right)
    return {k: (a.get(k), b.get(k)) for k in sorted(a.keys() | b.keys()) if a.get(k) != b.get(k) or (k in a) != (k in b)}


def missing_dates(calendar: DataFrame, present: DataFrame, day: str = "trading_date") -> DataFrame:
    """Calendar dates that a store does not have yet."""
    return calendar.select(day).distinct().join(present.select(day).distinct(), day, "left_anti")


def required_months(intervals: DataFrame, start: str, end: str) -> DataFrame:
    """Months that intervals touch, to prune partitions by a semi-join."""
    days = F.sequence(F.date_trunc("month", start).cast("date"), F.date_trunc("month", end).cast("date"), F.expr("interval 1 month"))
    return intervals.select(F.explode(days).alias("_m")).select(F.year("_m").alias("year"), F.month("_m").alias("month")).distinct()


BAR_SCHEMA = T.StructType([T.StructField("datetime", T.TimestampNTZType()), *[T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume", "wap")], T.StructField("bar_count", T.LongType()), T.StructField("symbol", T.StringType())])
TICK_SCHEMAS = {
    "TRADES": T.StructType([T.StructField("time", T.TimestampNTZType()), T.StructField("price", T.DoubleType()), T.StructField("size", T.DoubleType()), T.StructField("exchange", T.StringType()), T.StructField("conditions", T.StringType())]),
    "BID_ASK": T.StructType([T.StructField("time", T.TimestampNTZType()), *[T.StructField(c, T.DoubleType()) for c in ("bid", "ask", "bid_size", "ask_size")]]),
    "MIDPOINT": T.StructType([T.StructField("time", T.TimestampNTZType()), T.StructField("midpoint", T.DoubleType())]),
}
