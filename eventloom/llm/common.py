"""Helpers that several operators share."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
import weakref
from collections.abc import Callable

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Runs of the six ASCII white-space characters separate words.
SPACES = r"[\x20\x09-\x0D]+"
#: A word of letters and their marks, for the models that learn words.
LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text as an array; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def letter_words(text: str | None) -> list[str]:
    """The lower-cased words of letters of a text, for fitting and predicting alike."""
    return LETTERS.findall((text or "").lower())


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else the one set
    on the context, else (a local run, such as a test) a new temporary folder."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        if not jsc.isLocal():
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="llm-checkpoint-"))
    return jsc.getCheckpointDir().get().rstrip("/")


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def stored(df: DataFrame, tag: str, batch: int | None = None, batch_mb: int | None = None, options: dict[str, str] | None = None) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read again: it cuts the
    lineage, survives lost executors, and later reads take only the columns they need.
    The folder goes when the driver ends. With ``batch`` or ``batch_mb``, Python gets so many rows or MB at once at
    most (one row, however long, always goes whole), which bounds what a worker holds of long texts. ``options`` are those of the Parquet writer."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{tag}-{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k) for k in (BATCH, BATCH_BYTES)}
    try:
        if batch:
            spark.conf.set(BATCH, batch)
        if batch_mb:
            spark.conf.set(BATCH_BYTES, f"{batch_mb}m")
        df.write.options(**(options or {})).parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    atexit.register(_drop, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    PATHS[out] = path
    return out


#: Where stored tables lie.
PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``stored`` made and nothing reads any more, and shuffle files that no live DataFrame needs."""
    for t in tables:
        if path := PATHS.pop(t, None):
            _drop(t.sparkSession, path)
    release(tables[0].sparkSession)


def _drop(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    if sc._jsc is None:
        return
    try:
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the JVM may be gone already
        pass


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner remove shuffle files that no live DataFrame needs."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def give_back() -> None:
    """Return to the system what a Python worker has freed. Workers live on between stages, and what they
    keep of long texts adds up to their executor's memory."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc alone
    if trim:
        trim(0)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, also where the body uses it in a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(a: Column, op: Callable[[Column, Column], Column], width: int = 256) -> Column:
    """Running results of ``op`` (associative; 0 must not change a result) over an array of
    longs from 0 up, by built-in functions. Blocks of ``width`` keep the cost of a long
    array near linear."""
    zero, none = F.array().cast("array<long>"), F.lit(0).cast("long")

    def scan(x: Column) -> Column:
        return F.aggregate(x, zero, lambda acc, v: F.concat(acc, F.array(op(F.coalesce(F.try_element_at(acc, F.lit(-1)), none), v))))

    def total(blocks: Column) -> Column:
        last = F.transform(blocks, lambda b: F.coalesce(F.try_element_at(b, F.lit(-1)), none))
        before = F.concat(F.array(none), scan(last))
        return F.flatten(F.zip_with(blocks, F.slice(before, F.lit(1), F.size(blocks)), lambda b, off: F.transform(b, lambda v: op(v, off))))

    cut = lambda x: F.transform(F.sequence(F.lit(0), F.greatest(F.size(x) - 1, F.lit(0)), F.lit(width)), lambda i: scan(F.slice(x, i + 1, F.lit(width))))
    return let(let(a.cast("array<long>"), cut), total)


def running_totals(a: Column) -> Column:
    """Prefix sums: element k is the sum of elements 0..k."""
    return running(a, lambda x, y: x + y)


def spare(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` doesn't have, whatever its letters' case."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def rows_at_most(df: DataFrame, limit: int) -> bool:
    """Whether ``df`` has at most ``limit`` rows, without counting further."""
    return df.limit(limit + 1).count() <= limit
