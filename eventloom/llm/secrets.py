"""Secret scans with corpus-wide ownership frequency.

Spans come from three base patterns (assignments, access keys, long hex runs) and one
further candidate pattern (long mixed tokens). Every candidate value is hashed and
counted over the whole corpus by distinct owners and repositories: a value that many own
is a copied example, one that few own is taken for a live credential. Base spans always
stay in the report, with that verdict; a further candidate is added only where it is live.

Counting goes through (value, owner, repository) rows made distinct, so a value in a third
of all documents is combined before it meets in one place. A text stays in its task; only
spans and hashes move.

Null and empty texts have no span. Rows that repeat (doc_id, text) each keep their row; extra
columns are ignored, and ``redacted`` returns them whatever their names; empty tables give empty
results. Positions are running totals and overlaps a sweep in order, so a very long text with many spans
costs in proportion to them. Of spans that tie by start the kinds stand in the listed order. Positions count code points, ends are exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, running, running_totals, spare, stored

#: Fixed patterns; the hex pattern's runs are maximal, so its length bound is part of it.
ASSIGN = r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
GENERIC = r"[A-Za-z0-9+/_-]{20,}"
KINDS = ("assign", "access", "hex", "generic")
#: A value of this many owners, or of this many repositories, is a copied example.
EXAMPLE_OWNERS = 3
EXAMPLE_REPOS = 20

SPAN = "array<struct<start:long,end:long,kind:int,value:string>>"


def _spans(text: Column, pattern: str, kind: int, cheap: Column, group: int = 0, keep=lambda whole, value: F.lit(True)) -> Column:
    """Matches of a pattern with their positions: the pieces between matches, and the
    matches themselves, give every start as a running total of lengths."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.slice(F.split(text, pattern), F.lit(1), F.size(whole))
    ends = running_totals(F.zip_with(gaps, whole, lambda g, m: F.length(g) + F.length(m)))
    at = F.zip_with(whole, ends, lambda m, e: F.struct((e - F.length(m)).alias("start"), e.alias("end"), F.lit(kind).alias("kind")))
    rows = F.zip_with(at, value, lambda p, v: F.struct(p["start"].alias("start"), p["end"].alias("end"), p["kind"].alias("kind"), v.alias("value")))
    rows = F.filter(rows, lambda r: keep(r["end"] - r["start"], r["value"]))
    return F.when(cheap, rows).otherwise(F.array().cast(SPAN)).cast(SPAN)


def found(docs: DataFrame, repo: Column, owner: Column) -> DataFrame:
    """``doc_id, text_hash, repo, owner, base, more``: base spans and further candidates."""
    t = F.coalesce(F.col("text"), F.lit(""))
    x = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), repo.cast("string").alias("repo"), owner.cast("string").alias("owner"), t.alias("t"))
    t = F.col("t")
    x = x.select("doc_id", "text_hash", "repo", "owner", _spans(t, ASSIGN, 0, t.rlike(ASSIGN), 1, lambda n, v: F.length(v) >= 6).alias("a"), _spans(t, ACCESS, 1, t.contains("AKIA")).alias("b"), _spans(t, HEX, 2, t.rlike(HEX)).alias("c"), _spans(t, GENERIC, 3, t.rlike(GENERIC), 0, lambda n, v: v.rlike("[0-9]") & v.rlike("[a-z]") & v.rlike("[A-Z]")).alias("g"))
    key = lambda r: F.struct(r["start"].alias("start"), r["kind"].alias("kind"), r["end"].alias("end"), r["value"].alias("value"))
    x = x.select("doc_id", "text_hash", "repo", "owner", F.sort_array(F.transform(F.concat("a", "b", "c"), key)).alias("base"), F.transform("g", key).alias("g"))
    more = F.when((F.size("g") > 0) & (F.size("base") > 0), _apart(F.col("g"), F.col("base"))).otherwise(F.col("g"))
    return x.select("doc_id", "text_hash", "repo", "owner", "base", more.alias("more"))


def _apart(spans: Column, base: Column) -> Column:
    """The spans that overlap no base span, in one sweep: all ends of spans and starts of base
    spans in order, with the farthest end of the base spans so far."""
    long = F.lit(0).cast("long")
    at = lambda pos, kind, end, r: F.struct(pos.alias("pos"), F.lit(kind).alias("base"), end.alias("far"), r.alias("r"))
    events = F.sort_array(F.concat(F.transform(spans, lambda r: at(r["end"], 0, long, r)), F.transform(base, lambda r: at(r["start"], 1, r["end"], r))))
    swept = let(events, lambda e: F.zip_with(e, running(F.transform(e, lambda x: x["far"]), F.greatest), lambda x, far: F.struct(x["base"].alias("base"), x["r"].alias("r"), far.alias("far"))))
    return F.transform(F.filter(swept, lambda x: (x["base"] == 0) & (x["far"] <= x["r"]["start"])), lambda x: x["r"])


def ownership(spans: DataFrame) -> DataFrame:
    """``value_hash, n_owners, n_repos, example`` of every candidate value."""
    c = spans.select("repo", "owner", F.explode(F.concat("base", "more")).alias("s"))
    c = c.groupBy(F.sha2("s.value", 256).alias("value_hash"), "owner", "repo").agg(F.count("*").alias("n"))
    o = c.groupBy("value_hash", "owner").agg(F.count("*").alias("n_repos"))
    o = o.groupBy("value_hash").agg(F.count("*").alias("n_owners"), F.sum("n_repos").alias("n_repos"))
    return o.withColumn("example", (F.col("n_owners") >= EXAMPLE_OWNERS) | (F.col("n_repos") >= EXAMPLE_REPOS))


def scan(docs: DataFrame, repo: str = "doc_id", owner: str = "source") -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, text_hash``, ``base`` (base spans by start
    and kind) and ``spans`` (these and the added ones, each with ``example``)."""
    f = stored(found(docs, F.col(repo), F.col(owner)), "spans").withColumn("rid", F.struct("doc_id", "text_hash"))
    own = stored(ownership(f), "owners")
    one = f.where(F.size(F.concat("base", "more")) > 0).dropDuplicates(["doc_id", "text_hash"])
    s = one.select("doc_id", "text_hash", F.explode(F.concat("base", "more")).alias("s")).withColumn("value_hash", F.sha2("s.value", 256))
    s = s.join(own, "value_hash").where((F.col("s.kind") < 3) | ~F.col("example"))
    s = s.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_list(F.struct("s.start", "s.kind", "s.end", "s.value", "example", "n_owners", "n_repos"))).alias("spans"))
    s = s.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_h"), "spans")
    out = f.join(s, f.doc_id.eqNullSafe(s._id) & (f.text_hash == s._h), "left")
    return out.select("doc_id", "text_hash", "base", F.coalesce("spans", F.array().cast(s.schema["spans"].dataType)).alias("spans"))


def written(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda r: F.concat_ws(":", F.get(kinds, r["kind"]), r["start"].cast("string"), r["end"].cast("string"))), ",")


def redacted(docs: DataFrame, repo: str = "doc_id", owner: str = "source") -> DataFrame:
    """The documents, all rows and columns, with every span (overlapping ones as one)
    replaced by ``[REDACTED]`` and ``n_chars``, where there is one, counted anew."""
    i, h, s, t = (spare(docs, k) for k in ("span_id", "span_hash", "span_list", "text_hash"))
    spans = scan(docs, repo, owner).where(F.size("spans") > 0).select(F.col("doc_id").alias(i), F.col("text_hash").alias(h), F.col("spans").alias(s)).dropDuplicates([i, h])
    x = docs.withColumn(t, F.xxhash64("text")).join(spans, F.col("doc_id").eqNullSafe(F.col(i)) & (F.col(t) == F.col(h)), "left")
    x = x.withColumn("text", F.when(F.col(s).isNull(), F.col("text")).otherwise(masked(F.col("text"), F.col(s))))
    if "n_chars" in docs.columns:
        x = x.withColumn("n_chars", F.when(F.col(s).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return x.select(*docs.columns)


def masked(text: Column, spans: Column, width: int = 64) -> Column:
    """A text with the union of its spans (by start) replaced. Blocks of spans cut the text
    once each, so a long text with many spans isn't walked from its start for every one."""
    long = F.lit(0).cast("long")
    cut = lambda t, a, b: F.substring(t, (a + 1).cast("int"), F.greatest(b - a, long).cast("int"))
    ends = running(F.transform(spans, lambda r: r["end"]), F.greatest)
    before = F.concat(F.array(long), ends)
    cuts = F.zip_with(spans, F.slice(before, F.lit(1), F.size(spans)), lambda r, e: F.struct(e.alias("after"), r["start"].alias("start")))

    def block(b: Column) -> Column:
        base = F.get(b, F.lit(0))["after"]
        return let(cut(text, base, F.get(b, F.size(b) - 1)["start"]), lambda piece: F.array_join(F.transform(b, lambda c: F.when(c["start"] < c["after"], F.lit("")).otherwise(F.concat(cut(piece, c["after"] - base, c["start"] - base), F.lit("[REDACTED]")))), ""))

    blocks = let(cuts, lambda c: F.transform(F.sequence(F.lit(0), F.size(c) - 1, F.lit(width)), lambda i: let(F.slice(c, i + 1, F.lit(width)), block)))
    last = F.array_max(F.transform(spans, lambda r: r["end"]))
    return F.concat(F.array_join(blocks, ""), cut(text, last, F.length(text).cast("long")))


#: How many base spans of each kind a text has, for DuckDB.
COUNT_ORACLE = r"""
select doc_id, len(list_filter(regexp_extract_all(t, '(?i:password|passwd|secret|token|api_?key)[\x22\x27]?\x20*[:=]\x20*[\x22\x27]?([A-Za-z0-9+/_.=-]+)', 1), lambda x: length(x) >= 6))::bigint as n_assign,
       len(list_filter(regexp_extract_all(t, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 20))::bigint as n_access,
       len(list_filter(regexp_extract_all(t, '[0-9a-f]+'), lambda x: length(x) >= 24))::bigint as n_hex
from (select doc_id, coalesce(text, '') as t from documents)
"""
