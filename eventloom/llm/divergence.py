"""How far the sources of a language diverge in their words: an exact audit of all pairs, and of each source against
its language.

A language keeps the terms that at least ``MIN_DOCS`` of its documents have. A group (a source within a language) and the
language itself give each kept term a smoothed share in billionths, ``p = 1 + floor(1e9 (count + 1) / (N + V))``. Against
another share q a term adds ``floor((p - q)^2 / q)``. All of it is integer arithmetic, so partial sums add up exactly in any order.

A pair's sum over all kept terms is split. Writing p0 for a group's share of a term that it doesn't have, and f0 for what such
a term adds to a pair:

- every term adds f0, at first;
- a heavy term (in more than ``LIGHT`` groups of its language) adds what it differs from that, from dense numpy tiles
  of up to about ``BLOCK`` groups against as many, by about ``TILE`` terms;
- light terms add, for either side alone, by counts of how many terms have which share (a group has few distinct ones);
- and where both have the term, its posting list corrects the pair: at most ``LIGHT`` groups, so a bounded number of pairs.

What grows: terms are counted within batches first, and a term's postings are at most the groups of its language.
The result has a row for each ordered pair of groups of a language, so these are what its reader can hold; they are dealt
out over tiles by hash, never gathered. The table of groups is broadcast where it has at most ``BROADCAST_GROUPS`` rows,
otherwise joined by shuffle. Ranks to ``TOP`` are limited before the shuffle.

Null text, lang and source are empty strings; such groups count like others. A group without terms still has its pairs; a
language without kept terms has pairs of value 0. Repeated rows are documents of their own. Very long texts are read in
pieces; of one text only its distinct terms are held. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import rows_at_most, stored

MIN_DOCS = 3
TOP = 200
SCALE = 1_000_000_000
LIGHT = 8
BLOCK, TILE, SHARES = 64, 1024, 16_384
BROADCAST_GROUPS = 100_000
PIECE = 1 << 18
HELD = 400_000
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Runs of ASCII letters and of bytes of other scripts, in lower-cased UTF-8.
TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
PARTIAL = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n_docs", pa.int64()), ("n", pa.int64())])


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a lower-cased text, in lists of ``PIECE`` where it is long."""
    if len(text) <= PIECE:
        yield TERM.findall(text)
    else:
        found = (m.group() for m in TERM.finditer(text))
        while ws := list(islice(found, PIECE)):
            yield ws


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts by group and term within a task; a row without a term says that the group is there."""
    n: dict[tuple, Counter] = {}
    n_docs: dict[tuple, Counter] = {}
    held = 0

    def rows() -> Iterator[pa.RecordBatch]:
        for (lang, source), c in n.items():
            terms, d = list(c), n_docs[lang, source]
            own = [pa.array([None, *terms], pa.binary()).cast(pa.string()), pa.array([0, *map(d.__getitem__, terms)], pa.int64()), pa.array([0, *c.values()], pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang, pa.string()), len(c) + 1), pa.repeat(pa.scalar(source, pa.string()), len(c) + 1), *own], schema=PARTIAL)

    for b in batches:
        for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            c, d = n.setdefault((lang, source), Counter()), n_docs.setdefault((lang, source), Counter())
            own, before = set(), len(c)
            for ws in _pieces((text.as_py() or b"").translate(LOWER)):
                c.update(ws)
                own.update(ws)
            d.update(own)
            held += len(c) - before
            if held >= HELD:
                yield from rows()
                n, n_docs, held = {}, {}, 0
    yield from rows()


def share(n: Column, total: Column) -> Column:
    """A count's smoothed share in billionths; ``total`` is the group's count of kept terms plus their number."""
    wide = F.lit(SCALE).cast("decimal(10,0)") * (n + 1).cast("decimal(20,0)")
    return F.call_function("div", wide, total.cast("decimal(20,0)")) + 1


def added(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def counts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored: every group ``lang, source``; and every kept term ``lang, term, n, n_groups, posts``."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    chosen = docs.select(text("lang"), text("source"), text("text").cast("binary").alias("text"))
    part = chosen.mapInArrow(_counted, "lang string, source string, term string, n_docs long, n long")
    each = stored(part.groupBy("lang", "source", "term").agg(F.sum("n_docs").alias("n_docs"), F.sum("n").alias("n")), "term-counts", batch_mb=4)
    posts = F.collect_list(F.struct("source", "n")).alias("posts")
    terms = each.where("term is not null").groupBy("lang", "term").agg(F.sum("n_docs").alias("d"), F.sum("n").alias("n"), F.count("*").alias("n_groups"), posts)
    return each.where("term is null").select("lang", "source"), stored(terms.where(F.col("d") >= MIN_DOCS).drop("d"), "terms")


def totals(groups: DataFrame, terms: DataFrame) -> DataFrame:
    """Stored: ``lang, source, v, total, lang_total, p0, blocks, block, tiles``, a row a group. Totals are null in a language that keeps no term."""
    heavy = F.count(F.when(F.col("n_groups") > LIGHT, 1))
    lang = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("ln"), heavy.alias("heavy"))
    own = terms.select("lang", F.inline("posts")).groupBy("lang", "source").agg(F.sum("n").alias("gn"))
    size = groups.groupBy("lang").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    x = groups.join(size, "lang").join(lang, "lang", "left").join(own, ["lang", "source"], "left")
    x = x.withColumn("total", F.coalesce("gn", F.lit(0)) + F.col("v")).withColumn("lang_total", F.col("ln") + F.col("v"))
    tiles = F.ceil(F.coalesce("heavy", F.lit(0)) / TILE).cast("int")
    block = F.pmod(F.xxhash64("source"), "blocks").cast("int")
    return stored(x.select("lang", "source", F.coalesce("v", F.lit(0)).alias("v"), "total", "lang_total", share(F.lit(0).cast("long"), F.col("total")).alias("p0"), "blocks", block.alias("block"), tiles.alias("tiles")), "groups")


TILED = "lang string, source string, item string, value long"


def _tile(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """What a tile adds to each pair of its groups. Kind 0 has the groups with their p0 (and the number of terms, where the tile
    adds f0), 1 a heavy term, 2 a light share and how many terms have it."""
    told = rows[rows["kind"] == 0]
    if told.empty:  # one of the blocks has no group
        return pd.DataFrame([], columns=["lang", "source", "item", "value"])
    groups = told.iloc[0]
    side = lambda name: ([x["source"] for x in groups[name]], np.array([x["p"] for x in groups[name]], np.int64))
    (own, p0), (other, q0) = side("own"), side("other")
    f = lambda p, q: (p - q) ** 2 // q
    f0 = f(p0[:, None], q0[None, :])
    out = f0 * groups["v"]
    at, to = {s: i for i, s in enumerate(own)}, {s: i for i, s in enumerate(other)}
    heavy = rows[rows["kind"] == 1]
    if len(heavy):
        p, q = np.repeat(p0[:, None], len(heavy), 1), np.repeat(q0[:, None], len(heavy), 1)
        for k, (mine, theirs) in enumerate(zip(heavy["own"], heavy["other"], strict=True)):
            p[[at[x["source"]] for x in mine], k] = [x["p"] for x in mine]
            q[[to[x["source"]] for x in theirs], k] = [x["p"] for x in theirs]
        for g in range(len(own)):
            out[g] += f(p[g][None, :], q).sum(1) - len(heavy) * f0[g]
    for mine, theirs in rows.loc[rows["kind"] == 2, ["own", "other"]].itertuples(index=False):
        for x in mine:
            g = at[x["source"]]
            out[g] += x["m"] * (f(x["p"], q0) - f0[g])
        for x in theirs:
            h = to[x["source"]]
            out[:, h] += x["m"] * (f(p0, x["p"]) - f0[:, h])
    pairs = [(key[0], s, o, int(out[i, j])) for i, s in enumerate(own) for j, o in enumerate(other) if s != o]
    return pd.DataFrame(pairs, columns=["lang", "source", "item", "value"])


def pairs(groups: DataFrame, terms: DataFrame) -> DataFrame:
    """``lang, source, item, value`` for each ordered pair of groups of a language."""
    few = F.broadcast(groups) if rows_at_most(groups, BROADCAST_GROUPS) else groups
    posts = terms.select("lang", "term", "n_groups", F.inline("posts")).join(few, ["lang", "source"])
    posts = posts.select("lang", "source", "term", "n_groups", share(F.col("n"), F.col("total")).alias("p"), "p0", "blocks", "block", "tiles")
    light, heavy = posts.where(F.col("n_groups") <= LIGHT), posts.where(F.col("n_groups") > LIGHT)
    entry = lambda m=None: F.struct("source", "p", (F.lit(1).cast("long") if m is None else F.col(m)).alias("m"))

    # Light terms: how many have which share, and where two groups share a term.
    shares = stored(light.groupBy("lang", "source", "p", "blocks", "block").agg(F.count("*").alias("m")), "shares")
    n_shares = shares.groupBy("lang").agg(F.ceil(F.count("*") / SHARES).cast("int").alias("cuts"))
    both = light.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "p0")).alias("g")).where(F.size("g") > 1)
    gap = lambda x, y: added(x["p"], y["p"]) - added(x["p"], y["p0"]) - added(x["p0"], y["p"]) + added(x["p0"], y["p0"])
    each = F.flatten(F.transform("g", lambda x: F.transform(F.filter("g", lambda y: y["source"] != x["source"]), lambda y: F.struct(x["source"].alias("source"), y["source"].alias("item"), gap(x, y).alias("value")))))
    corrected = both.select("lang", F.inline(each))

    # Tiles: blocks of groups against blocks of groups, by cuts of heavy terms (from 0) and of light shares (below 0).
    kind = "array<struct<source:string,p:long,m:long>>"
    facing = F.explode(F.flatten(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(i.alias("a"), j.alias("b"))))))
    of = lambda c, side: F.transform(F.filter(c, lambda x: x["block"] == F.col(f"s.{side}")), lambda x: F.struct(x["source"], x["p"], x["m"])).cast(kind)
    cut = lambda df, number, t, c, v: df.select("lang", "blocks", number.alias("kind"), t.alias("t"), c.alias("c"), v.alias("v")).select("lang", "kind", "t", "v", "c", facing.alias("s")).select("lang", "s.a", "s.b", "t", "kind", "v", of("c", "a").alias("own"), of("c", "b").alias("other"))
    listed = F.collect_list(F.struct("source", "p", F.lit(1).cast("long").alias("m"), "block")).alias("c")
    zero = F.lit(0).cast("long")
    by_term = heavy.groupBy("lang", "term", "blocks", "tiles").agg(listed)
    dense = cut(by_term, F.lit(1), F.pmod(F.xxhash64("term"), "tiles").cast("int"), F.col("c"), zero)
    one = F.array(F.struct("source", "p", "m", "block"))
    sparse = cut(shares.join(F.broadcast(n_shares) if rows_at_most(n_shares, BROADCAST_GROUPS) else n_shares, "lang"), F.lit(2), -1 - F.pmod(F.xxhash64("p"), "cuts").cast("int"), one, zero)
    # A tile is told its two blocks alone, so groups meet by block, not by language.
    blocks = groups.where("v > 0").groupBy("lang", "block").agg(F.collect_list(F.struct("source", F.col("p0").alias("p"), F.lit(1).cast("long").alias("m"))).alias("g"), F.max("v").alias("v"), F.max("tiles").alias("tiles"))
    cuts = blocks.join(n_shares, "lang", "left").withColumn("cuts", F.greatest(F.coalesce("cuts", F.lit(1)), F.lit(1)))
    facing_blocks = cuts.alias("x").join(blocks.alias("y"), "lang").select("lang", F.col("x.block").alias("a"), F.col("y.block").alias("b"), F.col("x.g").alias("own"), F.col("y.g").alias("other"), F.col("x.v").alias("v"), F.explode(F.sequence(-F.col("cuts"), F.col("x.tiles") - 1)).alias("t"))
    told = facing_blocks.select("lang", "a", "b", "t", F.lit(0).alias("kind"), F.when(F.col("t") == -1, F.col("v")).otherwise(0).alias("v"), F.col("own").cast(kind).alias("own"), F.col("other").cast(kind).alias("other"))
    tiles = told.unionByName(dense).unionByName(sparse.where((F.size("own") > 0) | (F.size("other") > 0)))
    made = tiles.groupBy("lang", "a", "b", "t").applyInPandas(_tile, TILED)

    empty = groups.where("v = 0").select("lang", "source")
    nothing = empty.join(empty.withColumnRenamed("source", "item"), "lang").where("source <> item").select("lang", "source", "item", zero.alias("value"))
    return made.unionByName(corrected).groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).unionByName(nothing)


def distinctive(groups: DataFrame, terms: DataFrame) -> DataFrame:
    """``lang, source, item, value``: the terms of a group that have a larger share in it than in its language."""
    few = F.broadcast(groups) if rows_at_most(groups, BROADCAST_GROUPS) else groups
    x = terms.select("lang", F.col("term").alias("item"), F.col("n").alias("ln"), F.inline("posts")).join(few, ["lang", "source"])
    x = x.select("lang", "source", "item", share(F.col("n"), F.col("total")).alias("p"), share(F.col("ln"), F.col("lang_total")).alias("q"))
    return x.where("p > q").select("lang", "source", "item", added(F.col("p"), F.col("q")).alias("value"))


def audited(docs: DataFrame) -> DataFrame:
    """``lang, source, part, item, value, rank``: part ``pair`` against every other source of the language, part ``term``
    the ``TOP`` most distinctive terms."""
    groups, terms = counts(docs)
    groups = totals(groups, terms)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(order).alias("rank")
    first = distinctive(groups, terms).select("lang", "source", F.lit("term").alias("part"), "item", "value", rank).where(F.col("rank") <= TOP)
    return pairs(groups, terms).select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank).unionByName(first)


ORACLE = """
with d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as ws from documents),
g as (select distinct lang, source from d),
w as (select r, lang, source, unnest(ws) as term from d),
kept as (select lang, term, count(*) as ln from w group by all having count(distinct r) >= 3),
c as (select lang, source, term, count(*) as n from w join kept using (lang, term) group by lang, source, term),
v as (select lang, count(*) as v, sum(ln) as ln_all from kept group by 1),
grid as (select g.lang, g.source, k.term, coalesce(c.n, 0) as n, k.ln, v.v, v.ln_all, sum(coalesce(c.n, 0)) over (partition by g.lang, g.source) as gn
         from g join kept k using (lang) join v using (lang) left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
s as (select lang, source, term, n, (1 + 1000000000 * (n + 1)::hugeint // (gn + v))::bigint as p, (1 + 1000000000 * (ln + 1)::hugeint // (ln_all + v))::bigint as q from grid),
pr as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p)::bigint as value from s a join s b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
prz as (select a.lang, a.source, b.source as item, coalesce(pr.value, 0) as value from g a join g b on a.lang = b.lang and a.source <> b.source left join pr on pr.lang = a.lang and pr.source = a.source and pr.item = b.source),
tm as (select lang, source, term as item, (p - q) * (p - q) // q as value from s where n > 0 and p > q)
select lang, source, 'pair' as part, item, value, row_number() over (partition by lang, source order by value desc, item)::int as rank from prz
union all select * from (select lang, source, 'term' as part, item, value, row_number() over (partition by lang, source order by value desc, item)::int as rank from tm) where rank <= 200
"""
