"""Shared plumbing of the text operators: folders that the whole cluster sees,
Arrow batch sizes, and flat views of string columns for vectorised work."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Words of the contracts: runs without space and the ASCII controls 9 to 13.
WORD = "[^\\x20\\x09-\\x0D]+"


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once an application, unless their
    Python finds it by ``PYTHONPATH`` or the working folder."""
    home = Path(__file__).resolve().parents[2]
    known = [Path.cwd(), *(Path(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p)]
    app = spark.sparkContext.applicationId
    if app in _shipped or any(p.exists() and p.resolve() == home for p in known):
        return
    _shipped.add(app)
    path = Path(tempfile.mkdtemp(prefix="barloom-")) / "barloom.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted((home / "barloom").rglob("*.py")):
            z.write(f, f.relative_to(home))
    spark.sparkContext.addPyFile(str(path))


#: Bytes of an Arrow batch that goes to a Python worker.
BATCH_BYTES = 256 << 10


def text_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of whole texts small by their bytes. The setting holds
    for the session, so it is one constant for all operators, and a smaller one
    of the user stays."""
    ship(spark)
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def sliced(batches, rows: int = 128):
    """Batches of at most ``rows`` rows, where work memory follows the rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


_resident: dict = {}


def resident(key, make: Callable):
    """What a Python worker keeps from task to task; a new key takes the place
    of the one before."""
    if key not in _resident:
        _resident.clear()
        _resident[key] = make()
    return _resident[key]


def _trim() -> None:
    """Free memory goes back to the system, as idle workers share the
    executor's with its JVM."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run: Callable, keep: bool = False) -> Callable:
    """``run`` of a ``mapInArrow`` as a task that leaves no free memory behind.
    Unless it is to ``keep`` it, what earlier operators hold by ``resident`` in
    its worker goes first."""

    def task(batches):
        if not keep and _resident:
            _resident.clear()
            gc.collect()
            _trim()
        try:
            yield from run(batches)
        finally:
            _trim()

    return task


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).
    Where it is unset, as in local tests, a temporary one is set."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="barloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


#: Tables of up to this many rows are broadcast by ``side``.
BROADCAST_ROWS = 400_000


def side(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A narrow written table as the side of a join: broadcast if its counted
    rows are few, else joined by a shuffle."""
    return F.broadcast(df) if df.count() <= most else df


def spread(df: DataFrame, small: int = 32 << 20) -> DataFrame:
    """A small table in few files is dealt out to all cores, as a file that
    cannot be split would keep one of them busy. Larger ones stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < small and len(df.inputFiles()) < cores else df


def written(df: DataFrame, what: str, packed: bool = False) -> DataFrame:
    """Cut lineage: write to the shared folder and read again. Lost executors
    cost no more than the tasks that ran on them. ``packed`` deals a narrow table
    into files of like size first, as many as its bytes ask for."""
    spark = df.sparkSession
    if packed:
        df = df.hint("rebalance")
    path = f"{shared_dir(spark)}/barloom/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._barloom_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``written`` that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_barloom_path", None)
        if path:
            jvm = df.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def held_out(doc_id, modulus: int, rest: int):
    """Whether crc32 of the id as text has this remainder; false for null ids."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus == rest, F.lit(False))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n + 1 offsets into them; null
    counts as empty."""
    n = len(column)
    if column.null_count:
        column = column.fill_null("")
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def ngram_counts(column: pa.Array, dim: int, sizes: tuple[int, ...] = (1, 2, 3), fold: np.ndarray | None = None, step: int = 1 << 20) -> np.ndarray:
    """Counts of hashed byte n-grams, one row per text. ``fold`` maps bytes
    first (for example to lower case). Whole texts are used, in slices of
    ``step`` bytes, so memory does not follow the longest text."""
    data, offsets = flat(column)
    rows = len(offsets) - 1
    out = np.zeros(rows * dim, np.float32)
    ends = offsets[1:]
    for start in range(0, len(data), step):
        piece = data[start : start + step + max(sizes) - 1]
        if fold is not None:
            piece = fold[piece]
        piece = piece.astype(np.uint32)
        own = min(step, len(data) - start)
        first = int(np.searchsorted(ends, start, "right"))
        at = np.arange(start, start + own)
        row = first + np.searchsorted(ends[first:], at, "right") if rows - first < 64 else np.searchsorted(ends, at, "right")
        room = ends[row] - at
        lo, hi = int(row[0]), int(row[-1])
        for n in sizes:
            value = np.zeros(max(0, min(own, len(piece) - n + 1)), np.uint32)
            for k in range(n):
                value = value * np.uint32(257) + piece[k : k + len(value)]
            value = (value + np.uint32(n * 7919)) * np.uint32(2654435761)
            slot = (value >> np.uint32(7)) % np.uint32(dim)
            ok = room[: len(value)] >= n
            key = (row[: len(value)][ok] - lo) * dim + slot[ok]
            out[lo * dim : (hi + 1) * dim] += np.bincount(key, minlength=(hi - lo + 1) * dim).astype(np.float32)
    return out.reshape(rows, dim)


def class_sample(rows: DataFrame, label: str, per_class: int, keys: tuple[str, ...] = ("doc_id",), most: int | None = None) -> DataFrame:
    """A repeatable sample of about ``per_class`` rows of each label value, fewer
    if the label has so many values that this makes more than ``most`` rows: the
    rows whose hashed keys are below a bound set from the counts. Nothing hangs
    on the order of rows; rows with equal keys come all or not at all, so the
    caller drops repeats of them to hold the size. The counts, one a label
    value, come to the driver as the model's values do."""
    grain = 1 << 24
    counts = rows.groupBy(label).agg(F.count("*").alias("n")).collect()
    if most is not None:
        per_class = max(1, min(per_class, most // max(1, len(counts))))
    bounds = [(r[label], int(grain * min(1.0, per_class / r["n"]))) for r in counts]
    # by Arrow, as rows would start a second set of Python workers
    kind = to_arrow_type(rows.schema[label].dataType)
    table = rows.sparkSession.createDataFrame(pa.table({"_label": pa.array([v for v, _ in bounds], kind), "_bound": pa.array([n for _, n in bounds], pa.int64())}))
    drawn = rows.withColumn("_draw", F.pmod(F.xxhash64(*keys, F.lit(17)), F.lit(grain)))
    return drawn.join(F.broadcast(table), F.col(label) == F.col("_label")).where("_draw < _bound").drop("_draw", "_label", "_bound")


def dealt_pairs(rows: DataFrame, by: list[str], parts, node: str = "node") -> DataFrame:
    """Deal the rows of each group ``by`` into cells that hold all its pairs.
    ``parts`` is an aggregate that tells into how many chunks a group is cut, by
    the hash of ``node``; every pair of chunks is a cell ``i, j``, and ``side``
    tells to which of the two the row belongs. A row has a copy per chunk."""
    sizes = rows.groupBy(*by).agg(F.greatest(F.lit(1), parts).cast("int").alias("_g"))
    rows = rows.join(sizes, by).withColumn("_c", F.pmod(F.xxhash64(node, F.lit(3)), F.col("_g")).cast("int"))
    cell = lambda k: F.struct(F.least(k, F.col("_c")).alias("i"), F.greatest(k, F.col("_c")).alias("j"), F.when(F.col("_c") > k, 1).otherwise(0).alias("side"))
    return rows.select("*", F.inline(F.transform(F.sequence(F.lit(0), F.col("_g") - 1), cell))).drop("_g", "_c")


def sparse(counts: np.ndarray) -> bytes:
    """Places and values of what is not 0 in a row of counts."""
    at = np.flatnonzero(counts)
    return at.astype(np.uint32).tobytes() + counts[at].astype(np.uint32).tobytes()


def unsparse(raw: bytes, into: np.ndarray) -> None:
    both = np.frombuffer(raw, np.uint32)
    into[both[: len(both) // 2]] = both[len(both) // 2 :]


_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
LOWER_ASCII = np.arange(256, dtype=np.uint8)
LOWER_ASCII[65:91] += 32
_BASE, _BACK = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_powers: list[np.ndarray] = []


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x + np.uint64((salt * 0xD1B54A32D192ED03) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if not _powers or len(_powers[0]) <= n:
        size = max(1 << 16, n + 1)
        _powers[:] = [np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size, f, np.uint64)])) for f in (_BASE, _BACK)]
    return _powers[0], _powers[1]


def word_hashes(data: np.ndarray, offsets: np.ndarray, fold: np.ndarray | None = None, step: int = 1 << 22) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of all words, the row of each and its length in bytes.
    Whole texts are read; slices end between words, so that memory follows the
    slice and not the longest text."""
    hashes, rows, sizes = [], [], []
    begin, total = 0, len(data)
    first = np.zeros(total + 1, bool)
    first[offsets] = True
    while begin < total:
        end = min(total, begin + step)
        while end < total and not _SPACE[data[end]] and not first[end]:
            more = np.flatnonzero(_SPACE[data[end : end + step]] | first[end : min(total, end + step)])
            end = end + int(more[0]) if len(more) else min(total, end + step)
        piece = data[begin:end]
        inside = ~_SPACE[piece]
        edge = first[begin:end]
        head = inside & (edge | np.concatenate([[True], ~inside[:-1]]))
        tail = inside & np.concatenate([edge[1:] | ~inside[1:], [True]])
        s, e = np.flatnonzero(head), np.flatnonzero(tail) + 1
        if len(s):
            power, back = _power(len(piece))
            value = (fold[piece] if fold is not None else piece).astype(np.uint64) + np.uint64(1)
            run = np.concatenate([[np.uint64(0)], np.cumsum(value * power[: len(piece)])])
            size = (e - s).astype(np.int64)
            hashes.append(mixed((run[e] - run[s]) * back[s] + size.astype(np.uint64) * np.uint64(0xA24BAED4963EE407)))
            rows.append(np.searchsorted(offsets, s + begin, "right") - 1)
            sizes.append(size)
        begin = end
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(rows), np.concatenate(sizes)
