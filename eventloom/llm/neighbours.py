"""Nearest neighbours by inner product: cross-polytope hashing with multiprobe tables, and exact reranking.

Vectors are scaled by the largest norm M and get one more coordinate, sqrt(1 - |x|^2 / M^2) for those that are searched and
0 for queries, which are normalised: the nearest by inner product is then the nearest by angle. A pseudo-rotation is three
rounds of random signs and a fast Hadamard transform (dimensions padded to a power of two); a hash is the signed axis of
the rotated vector's largest coordinate among the leading ones. A table's key joins as many hashes, the last over few axes, as make
buckets of about ``BUCKET`` distinct vectors, so what a query reads doesn't grow with the table. A query probes ``PROBES``
buckets in each of ``TABLES`` tables, those of the axes with the least loss to its largest coordinates.

In a bucket every candidate is reranked exactly by numpy, in double precision on the vectors as given, and only the best of each
query leave it; these meet by query. Recall is measured, not bounded: see README and the tests.

What grows: each distinct vector is stored in every table. Equal vectors are one, with as many of their smallest ids as
can be among a query's nearest. Buckets are cut in pieces of about ``PIECE`` vectors by hash, and each query goes to all
pieces of its bucket, in groups, so that no task gets a whole crowded bucket. Queries that find fewer than asked for are searched
against all vectors, in pieces too. Each piece's result is at most ``k + 1`` rows a query.

Vectors that are null, zero, or hold null or non-finite components take no part, nor do those of another length than most (ties:
the shortest). A null id is a candidate that comes last among ties, and is no query. Repeated rows count each; of equal rows
a query leaves out one. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import rows_at_most, stored

K = 20
EVERY = 20
TABLES, PROBES = 12, 10
BUCKET, PIECE = 256, 4096
QUERIES = 1024
BROADCAST_BUCKETS = 100_000
ROUNDS = 3


def hadamard(x: np.ndarray) -> np.ndarray:
    """The normalised fast Walsh-Hadamard transform of each row."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def axes(n: int, dim: int) -> list[int]:
    """How many leading axes each hash of a key reads, for n vectors: each gives twice as many symbols."""
    bits, out = max(1, round(np.log2(max(2, n) / BUCKET))), []
    while bits > 0:
        out.append(min(dim, 1 << (bits - 1)))
        bits -= int(np.log2(out[-1])) + 1
    return out


def rotated(x: np.ndarray, table: int, number: int) -> np.ndarray:
    r = np.random.default_rng([table, number])
    for _ in range(ROUNDS):
        x = hadamard(x * r.choice([-1.0, 1.0], x.shape[1]))
    return x


def keys(x: np.ndarray, table: int, sizes: list[int], probes: int) -> np.ndarray:
    """The first ``probes`` bucket keys of each row in a table, its own first."""
    n = len(x)
    loss, key = np.zeros((n, 1)), np.zeros((n, 1), np.int64)
    for number, size in enumerate(sizes):
        r = rotated(x, table, number)[:, :size]
        both = np.concatenate([r, -r], axis=1)
        best = np.argsort(-both, axis=1, kind="stable")[:, :probes]
        v = np.take_along_axis(both, best, 1)
        loss = (loss[:, :, None] + ((v[:, :1] - v) ** 2)[:, None, :]).reshape(n, -1)
        key = (key[:, :, None] * (2 * size) + best[:, None, :]).reshape(n, -1)
        order = np.argsort(loss, axis=1, kind="stable")[:, :probes]
        loss, key = np.take_along_axis(loss, order, 1), np.take_along_axis(key, order, 1)
    return key


def lifted(v: np.ndarray, norm: float, query: bool) -> np.ndarray:
    """Unit vectors with one more coordinate, padded to a power of two."""
    out = np.zeros((len(v), 1 << v.shape[1].bit_length()))
    if query:
        out[:, : v.shape[1]] = v / np.linalg.norm(v, axis=1, keepdims=True)
    else:
        out[:, : v.shape[1]] = v / norm
        out[:, v.shape[1]] = np.sqrt(np.maximum(0.0, 1.0 - (out**2).sum(1)))
    return out


def sound(c: Column) -> Column:
    odd = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return c.isNotNull() & ~F.coalesce(odd, F.lit(False)) & F.exists(c, lambda x: x != 0)


def _usable(rows: DataFrame) -> DataFrame:
    """``vec_id, v, key``: sound vectors, with a hash that equal vectors share (-0.0 equals 0.0)."""
    kind = rows.schema["embedding"].dataType
    v = F.transform("embedding", lambda x: x + F.lit(0.0)).cast(kind)
    return rows.where(sound(F.col("embedding"))).select("vec_id", v.alias("v")).withColumn("key", F.unhex(F.sha2(F.array_join(F.col("v").cast("array<double>"), ","), 256)))


def distinct_vectors(usable: DataFrame, k: int) -> DataFrame:
    """Stored: ``key, v, ids, norm``, a row a distinct vector with the smallest ``k + 1`` ids that have it. Other ids are dropped
    within the tasks that read them, before anything moves."""
    size = usable.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "n").first()
    first = F.row_number().over(Window.partitionBy("key").orderBy(F.asc_nulls_last("vec_id")))
    few = usable.where(F.size("v") == (size["n"] if size else 0)).withColumn("_r", first).where(F.col("_r") <= k + 1)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("_r", "vec_id"))), lambda x: x["vec_id"]).alias("ids")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    return stored(few.groupBy("key").agg(F.first("v").alias("v"), listed).withColumn("norm", norm), "vectors").withColumn("vid", F.monotonically_increasing_id())


def _block(v: pd.Series) -> np.ndarray:
    return np.stack(v.to_list()).astype(np.float64)


def _best(q: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions and inner products of each query's ``k`` best rows of x (with those that tie with the last). A matrix product
    finds them, to within its rounding; the products that count are summed pair by pair, alike in every block."""
    s = q @ x.T
    slack = 1e-10 * np.linalg.norm(q, axis=1, keepdims=True) * np.linalg.norm(x, axis=1).max()
    least = -np.partition(-s, k - 1, axis=1)[:, k - 1 : k] - slack if s.shape[1] > k else np.full((len(s), 1), -np.inf)
    at, to = np.nonzero(s >= least)
    return at, to, (q[at] * x[to]).sum(1)


FOUND = "query long, vid long, score double"


def _searched(queries: DataFrame, vectors: DataFrame, by: list[str], k: int) -> DataFrame:
    """The best of every query among the vectors that meet it by the given columns."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query": [], "vid": [], "score": []})
        at, to, s = _best(_block(left["v"]), _block(right["v"]), k)
        return pd.DataFrame({"query": left["vid"].to_numpy()[at], "vid": right["vid"].to_numpy()[to], "score": s})

    return queries.groupBy(*by).cogroup(vectors.groupBy(*by)).applyInPandas(run, FOUND)


def _top(found: DataFrame, k: int) -> DataFrame:
    """``query, vid, score``: the ``k`` best distinct vectors of each query, with those that tie with the last."""
    place = F.rank().over(Window.partitionBy("query").orderBy(F.desc("score")))
    return found.groupBy("query", "vid").agg(F.max("score").alias("score")).withColumn("_r", place).where(F.col("_r") <= k).drop("_r")


def _keyed(x: DataFrame, sizes: list[int], norm: float, tables: int, probes: int, query: bool, vectors: bool = True) -> DataFrame:
    """A row for each bucket that a vector is in (or that a query probes)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if b.empty:
                continue
            z = lifted(_block(b["v"]), norm, query)
            for t in range(tables):
                key = keys(z, t, sizes, probes) * tables + t
                for p in range(key.shape[1]):
                    more = {"vid": b["vid"].to_numpy(), "v": b["v"].to_numpy()} if vectors else {}
                    yield pd.DataFrame({"bucket": key[:, p], **more})

    kind = x.schema["v"].dataType.simpleString()
    return x.select("vid", "v").mapInPandas(run, f"bucket long, vid long, v {kind}" if vectors else "bucket long")


def _crowded(buckets: DataFrame, most: int, name: str) -> DataFrame:
    """The buckets of more than ``most`` rows, and into how many parts they are cut."""
    n = buckets.groupBy("bucket").agg(F.ceil(F.count("*") / most).cast("int").alias(name)).where(F.col(name) > 1)
    n = stored(n, name)
    return F.broadcast(n) if rows_at_most(n, BROADCAST_BUCKETS) else n


def _parted(x: DataFrame, cut: DataFrame, name: str, copies: DataFrame, other: str) -> DataFrame:
    """Rows dealt to a part of their own side's cut, and copied to all parts of the other side's."""
    one = lambda c: F.coalesce(c, F.lit(1))
    x = x.join(cut, "bucket", "left").join(copies, "bucket", "left")
    return x.withColumn(name, F.pmod(F.xxhash64("vid"), one(name)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), one(other) - 1)))


def nearest(rows: DataFrame, k: int = K, every: int = EVERY, tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """``query_id, rank, vec_id, score``: of each row whose id ``every`` divides, the ``k`` nearest other rows found."""
    usable = _usable(rows)
    vectors = distinct_vectors(usable, k)
    about = vectors.agg(F.count("*").alias("n"), F.max("norm").alias("norm"), F.max(F.size("v")).alias("d")).first()
    if not about["n"]:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    asked = usable.where(F.pmod("vec_id", F.lit(every)) == 0).select(F.col("vec_id").alias("query_id"), "key")
    wanted = stored(vectors.join(asked.select("key").distinct(), "key", "left_semi").select("vid", "v"), "queries")
    sizes = axes(about["n"], 1 << about["d"].bit_length())
    keyed = lambda x, n, q, v=True: _keyed(x, sizes, about["norm"], tables, n, q, v)
    cuts, groups = _crowded(keyed(vectors, 1, False, False), PIECE, "piece"), _crowded(keyed(wanted, probes, True, False), QUERIES, "group")
    index = _parted(keyed(vectors, 1, False), cuts, "piece", groups, "group")
    probed = _parted(keyed(wanted, probes, True), groups, "group", cuts, "piece")
    # A query finds itself too, so one more is asked for.
    found = stored(_top(_searched(probed, index, ["bucket", "piece", "group"], k + 1), k + 1), "found")

    have = found.join(vectors.select("vid", F.size("ids").alias("n")), "vid").groupBy("query").agg(F.sum("n").alias("n"))
    short = stored(wanted.join(have.where(F.col("n") > k).select(F.col("query").alias("vid")), "vid", "left_anti"), "short")
    if n_short := short.count():
        part = lambda n: F.pmod(F.xxhash64("vid"), F.lit(n)).cast("int")
        every_ = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        n_pieces, n_groups = -(-about["n"] // PIECE), -(-n_short // QUERIES)
        ask = short.withColumns({"group": part(n_groups), "piece": every_(n_pieces)})
        exact = _top(_searched(ask, vectors.select("vid", "v", part(n_pieces).alias("piece"), every_(n_groups).alias("group")), ["piece", "group"], k + 1), k + 1)
        found = found.join(short.select(F.col("vid").alias("query")), "query", "left_anti").unionByName(exact)

    # Ids of the found vectors, nearest first; of its own vector's ids a query leaves out its own, once.
    ids = found.join(vectors.select("vid", "ids"), "vid").select("query", "score", (F.col("query") == F.col("vid")).alias("same"), F.explode("ids").alias("vec_id"))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), F.desc("same")))
    first = ids.withColumn("r", place).where(F.col("r") <= k + 1).groupBy("query").agg(F.array_sort(F.collect_list(F.struct("r", "vec_id", "score", "same"))).alias("a"))
    named = first.join(vectors.select(F.col("vid").alias("query"), "key"), "query").select("key", "a")
    own = F.array_min(F.transform(F.filter("a", lambda e: e["same"] & e["vec_id"].eqNullSafe(F.col("query_id"))), lambda e: e["r"]))
    rest = F.slice(F.filter("a", lambda e: ~e["r"].eqNullSafe(F.col("own"))), 1, k)
    out = asked.join(named, "key").withColumn("own", own).select("query_id", F.posexplode(rest).alias("p", "y"))
    return out.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("y.vec_id").alias("vec_id"), F.col("y.score").alias("score"))
