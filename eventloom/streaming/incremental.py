"""Partial results of batches, kept in a log that is compacted as it grows.

Each batch stores its partial results of cutflow, bin flow and histogram cells in a folder of its own; partial results
are additive and exact, so they may meet in any order. Where ``MERGE`` folders of one level are complete, their sum becomes one
of the level above, and they go. A folder is named by the range of batches that it holds and counts only once its
last file, an empty marker, is there; readers take the widest complete folders and leave out what these cover. So a batch that is run
again, or a compaction that was cut short, changes nothing, and n batches leave at most MERGE folders a level,
of log n levels.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..language.model import Analysis
from ..operators import bins
from ..operators.cutflow import depths, from_depths
from ..operators.exactsum import added
from ..operators.histograms import MOMENTS, cell_parts
from ..operators.histograms import from_parts as cells_from
from ..plans.planner import Plan, plan
from ..sources.lines import numbered, placed

MERGE = 8
#: Tables of partial results with their keys and what else is summed.
TABLES = {
    "depths": (("region", "depth", "failed", "e"), ("n",)),
    "bins": ((*bins.KEYS, "e"), ("raw",)),
    "cells": (("hist", "cell", "e"), ("entries", *MOMENTS[2:])),
}
DONE = "_DONE"


def parts(p: Plan) -> dict[str, DataFrame]:
    return {"depths": depths(p), "bins": bins.flow_parts(p), "cells": cell_parts(p)}


class Log:
    """The folders ``first-last`` under a path, on any file system that Spark reads."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _ranges(self) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
        """Complete folders, and others."""
        root = self._at(self.path)
        names = [s.getPath().getName() for s in self._fs.listStatus(root)] if self._fs.exists(root) else []
        all_ = [(int(m[1]), int(m[2])) for n in names if (m := re.fullmatch(r"(\d+)-(\d+)", n))]
        done = {r for r in all_ if self._fs.exists(self._at(f"{self.folder(r)}/{DONE}"))}
        return sorted(done), sorted(set(all_) - done)

    def folder(self, r: tuple[int, int]) -> str:
        return f"{self.path}/{r[0]}-{r[1]}"

    def current(self) -> list[tuple[int, int]]:
        """The complete folders that no other complete one covers, in order."""
        done, _ = self._ranges()
        return [r for r in done if not any(o != r and o[0] <= r[0] and r[1] <= o[1] for o in done)]

    def covers(self, batch: int) -> bool:
        return any(a <= batch <= b for a, b in self.current())

    def write(self, r: tuple[int, int], tables: dict[str, DataFrame]) -> None:
        at = self.folder(r)
        for name, df in tables.items():
            df.coalesce(1).write.mode("overwrite").parquet(f"{at}/{name}")
        self._fs.create(self._at(f"{at}/{DONE}"), True).close()

    def read(self, name: str, ranges: list[tuple[int, int]]) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.folder(r)}/{name}" for r in ranges])

    def summed(self, name: str, ranges: list[tuple[int, int]]) -> DataFrame:
        keys, sums = TABLES[name]
        return self.read(name, ranges).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums], *added())

    def note(self, batch: int, n: int) -> None:
        """Keep a number for a batch, and drop those of batches long gone."""
        at = lambda b: self._at(f"{self.path}/next-{b}")
        out = self._fs.create(at(batch), True)
        out.writeLong(n)
        out.close()
        if batch > 1:
            self._fs.delete(at(batch - 2), False)

    def noted(self, batch: int) -> int | None:
        at = self._at(f"{self.path}/next-{batch}")
        if not self._fs.exists(at):
            return None
        got = self._fs.open(at)
        try:
            return got.readLong()
        finally:
            got.close()

    def compact(self, merge: int) -> None:
        """Add up neighbouring folders of one size, while there are ``merge`` of them, and drop what is covered."""
        while True:
            now = self.current()
            runs = [now[k : k + merge] for k in range(len(now) - merge + 1)]
            size = lambda r: r[1] - r[0] + 1
            ready = next((x for x in runs if len({size(r) for r in x}) == 1 and x[0][0] % (size(x[0]) * merge) == 0 and all(a[1] + 1 == b[0] for a, b in zip(x, x[1:], strict=False))), None)
            if ready is None:
                break
            self.write((ready[0][0], ready[-1][1]), {name: self.summed(name, ready) for name in TABLES})
        done, _ = self._ranges()
        for r in set(done) - set(self.current()):
            self._fs.delete(self._at(self.folder(r)), True)


def store_batch(analysis: Analysis, df: DataFrame, number: int, path: str, merge: int = MERGE) -> None:
    """Store a batch's partial results, unless a folder holds them already, and compact the log."""
    log = Log(df.sparkSession, path)
    if not log.covers(number):
        df.persist()
        try:
            log.write((number, number), parts(plan(analysis, df)))
        finally:
            df.unpersist()
    log.compact(merge)


def accumulate(analysis: Analysis, events: DataFrame, path: str, checkpoint: str, merge: int = MERGE, **trigger) -> StreamingQuery:
    """Start a query that stores each batch's partial results under ``path``; a batch that is run
    again changes nothing."""
    return events.writeStream.foreachBatch(lambda df, number: store_batch(analysis, df, number, path, merge)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def current_cutflow(spark: SparkSession, analysis: Analysis, path: str) -> DataFrame:
    log = Log(spark, path)
    return from_depths(plan(analysis, spark.createDataFrame([], "event long")), log.summed("depths", log.current()))


def current_bins(spark: SparkSession, path: str) -> DataFrame:
    log = Log(spark, path)
    return bins.from_parts(log.read("bins", log.current()))


def current_cells(spark: SparkSession, path: str) -> DataFrame:
    log = Log(spark, path)
    return cells_from(log.read("cells", log.current()))


def number_batch(df: DataFrame, number: int, path: str) -> DataFrame:
    """The lines of a batch (``sources.lines.placed``) with ``file, line, ordinal``, dense over all batches in their order. Each batch notes where
    the next one begins; one that is run again begins where it did. Lines are numbered within their file as far as the batch has it."""
    log = Log(df.sparkSession, path)
    first = log.noted(number - 1) if number else 0
    if first is None:
        raise ValueError(f"batch {number - 1} has not noted where batch {number} begins")
    lines, n = numbered(df)
    log.note(number, first + n)
    return lines.withColumn("ordinal", F.col("ordinal") + first)


def numbered_stream(spark: SparkSession, source: str, path: str, checkpoint: str, use: Callable[[DataFrame, int], None], **trigger) -> StreamingQuery:
    """Start a query over text files that come in; ``use`` gets each batch's numbered lines and the batch's number."""

    def batch(df: DataFrame, number: int) -> None:
        df.persist()  # both passes see the same splits
        try:
            use(number_batch(df, number, path), number)
        finally:
            df.unpersist()

    return placed(spark.readStream.text(source)).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
