"""Canonical events as JSON lines.

Nothing is inferred. A line is one JSON object: arrays of objects are collections, and what else it holds are numbers, or
an object with numbers for missing momentum and triggers. All keys and properties are brought to their canonical names and
all are checked, whether the analysis reads them or not; only those that it reads become columns. What is wrong with a line
raises with its number, or is told in the column ``_parse_error``:

- it is no JSON object, or has more after it, or holds a text, a truth value or anything nested deeper;
- two of its keys, or two properties of one object, have one canonical name (``jet`` and ``Jets``, ``m`` and ``mass``);
- a number isn't finite, or outside its domain: pt, e and the HT family are not negative, tags and triggers are 0 or 1;
- a collection doesn't fall in pt.

A null stands for a key or property that isn't there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..language.model import Analysis, walk
from ..language.names import COLLECTIONS, MET, PROPERTIES, SCALARS, TAGS
from .lines import BLANK, blank, numbered_lines

OBJECTS = "array<map<string,double>>"


def reads(a: Analysis) -> tuple[dict[str, list[str]], list[str], list[str]]:
    """Collections with the properties read, scalars, and triggers of an analysis."""
    nodes = [n for r in a.regions.values() for s in r.steps for n in walk((s.node or (), s.histo.exprs if s.histo else ()))]
    bases = sorted({n[1] for n in nodes if n[0] == "base"})
    props = {n[2] for n in nodes if n[0] == "prop"} | {"pt"}
    if any(n[0] in ("angle", "pair", "pairs", "sum") for n in nodes) or any(n[0] == "combine" for n in nodes):
        props |= {"eta", "phi", "m"}
    return {b: sorted(props) for b in bases}, sorted({n[1] for n in nodes if n[0] == "scalar"}), sorted({n[1] for n in nodes if n[0] == "trigger"})


def _renamed(name: Column, table: dict[str, str]) -> Column:
    """A name by a small table of canonical ones, else itself."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), name), name)


BY_SPELLING = {s.lower(): name for name, all_ in COLLECTIONS.items() for s in all_.split()}


def shape(line: Column) -> Column:
    """Whether a line that is JSON is one object of numbers, flat objects of numbers, and arrays of these. Texts are left only
    as keys; what then remains is numbers and brackets, which are folded from the inside out."""
    t = F.regexp_replace(line, r"\\.", "")
    t = F.regexp_replace(t, r'"[^"]*"\s*:', "")
    t = F.regexp_replace(t, r"null|-?[0-9]+(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?", "0")
    t = F.regexp_replace(t, r"\s+", "")
    whole = F.regexp_replace(F.regexp_replace(F.substring(t, 2, 2147483647), r"\{[0,]*\}", "1"), r"\[[1,]*\]", "2")
    return t.startswith("{") & whole.rlike(r"^[012,]*\}$")


def _first(wrong: list[Column]) -> Column:
    return F.coalesce(*wrong, F.lit(None).cast("string"))


def _odd(v: Column) -> Column:
    return F.isnan(v) | (F.abs(v) == F.lit(float("inf")))


def _object_error(o: Column, name: Column) -> Column:
    """What is wrong with an object's canonical properties, an array of ``p, x``."""
    some = lambda test: F.exists(o, lambda e: F.coalesce(test(e), F.lit(False)))
    say = lambda what: F.concat(name, F.lit(what))
    return _first([
        F.when(F.size(F.array_distinct(F.transform(o, lambda e: e["p"]))) < F.size(o), say(" has two properties of one canonical name")),
        F.when(some(lambda e: _odd(e["x"])), say(" has a number that isn't finite")),
        F.when(some(lambda e: e["p"].isin("pt", "e") & (e["x"] < 0)), say(" has a negative pt or e")),
        F.when(some(lambda e: e["p"].isin(*sorted(TAGS)) & ~e["x"].isin(0.0, 1.0)), say(" has a tag that is neither 0 nor 1")),
    ])


def _objects_error(objects: Column, name: Column) -> Column:
    pts = F.filter(F.transform(objects, lambda o: F.get(F.filter(o, lambda e: e["p"] == "pt"), 0)["x"]), lambda v: v.isNotNull())
    rises = F.exists(F.zip_with(pts, F.slice(pts, F.lit(2), F.size(pts)), lambda a, b: b > a), lambda v: F.coalesce(v, F.lit(False)))
    one = F.get(F.filter(F.transform(objects, lambda o: _object_error(o, name)), lambda e: e.isNotNull()), 0)
    return _first([one, F.when(rises, F.concat(name, F.lit(" doesn't fall in pt")))])


def entries(line: Column) -> Column:
    """A line's keys as an array of ``kind, name, number, objects, error``; null where it is no JSON object. ``objects`` are arrays of
    canonical ``p, x``, one of them for missing momentum and triggers."""
    kinds = lambda lk, v: F.when(lk.isin("triggers", "weight"), lk).when(lk.isin(*sorted(MET)), F.lit("met")).when(v.startswith("["), F.lit("collection")).otherwise(F.lit("scalar"))

    def named(e: Column) -> Column:
        lk = F.lower(e["key"])
        kind = kinds(lk, e["value"])
        return F.struct(kind.alias("kind"), F.when(kind == "collection", _renamed(lk, BY_SPELLING)).when(kind == "met", F.lit("MET")).otherwise(lk).alias("name"), e["value"].alias("v"))

    def decoded(e: Column) -> Column:
        one = F.when(e["v"].startswith("{"), F.concat(F.lit("["), e["v"], F.lit("]"))).otherwise(e["v"])
        objects = F.when(e["v"].startswith("[") | e["v"].startswith("{"), F.from_json(one, OBJECTS))
        canon = lambda k: F.when(e["kind"] == "triggers", F.lower(k)).otherwise(_renamed(F.lower(k), PROPERTIES))
        objects = F.transform(objects, lambda m: F.transform(F.filter(F.map_entries(m), lambda x: x["value"].isNotNull()), lambda x: F.struct(canon(x["key"]).alias("p"), x["value"].alias("x"))))
        return F.struct(e["kind"].alias("kind"), e["name"].alias("name"), e["v"].try_cast("double").alias("number"), objects.alias("objects"), e["v"].alias("v"))

    def checked(e: Column) -> Column:
        kind, name, v, number, objects = (e[c] for c in ("kind", "name", "v", "number", "objects"))
        sound = objects.isNotNull() & F.coalesce(~F.exists(objects, lambda o: o.isNull()), F.lit(False))
        odd = number.isNull() | F.coalesce(_odd(number), F.lit(False))
        say = lambda what: F.concat(name, F.lit(what))
        flags = F.exists(F.get(objects, 0), lambda x: ~x["x"].isin(0.0, 1.0))
        twice = F.size(F.array_distinct(F.transform(F.get(objects, 0), lambda x: x["p"]))) < F.size(F.get(objects, 0))
        error = (
            F.when((kind == "collection") & ~sound, say(" is no array of objects with numbers"))
            .when(kind == "collection", _objects_error(objects, name))
            .when((kind == "met") & v.startswith("{") & sound, _object_error(F.get(objects, 0), name))
            .when((kind == "met") & odd, say(" is neither a number nor an object with numbers"))
            .when((kind == "met") & (number < 0), say(" has a negative pt"))
            .when((kind == "triggers") & (~v.startswith("{") | ~sound), say(" is no object with numbers"))
            .when((kind == "triggers") & twice, say(" has two flags of one name"))
            .when((kind == "triggers") & flags, say(" has a flag that is neither 0 nor 1"))
            .when(kind.isin("weight", "scalar") & odd, F.when(v.startswith("{") | (kind == "scalar"), say(" is neither a number nor an array of objects")).otherwise(say(" is no number")))
            .when((kind == "scalar") & name.isin(*sorted(SCALARS)) & (number < 0), say(" is negative"))
        )
        return F.struct(kind.alias("kind"), name.alias("name"), number.alias("number"), objects.alias("objects"), error.alias("error"))

    top = F.from_json(line, "map<string,string>")
    there = F.filter(F.map_entries(top), lambda e: e["value"].isNotNull())
    return F.transform(F.transform(F.transform(there, named), decoded), checked)


def line_error(line: Column, e: Column) -> Column:
    """What is wrong with a line of some entries, if anything."""
    key = lambda x: F.struct(x["kind"], x["name"])
    names = F.transform(e, key)
    again = F.get(F.filter(names, lambda x, i: F.array_position(names, x) <= i), 0)
    return _first([
        F.when(e.isNull(), F.lit("the line is no JSON object")),
        F.get(F.filter(F.transform(e, lambda x: x["error"]), lambda x: x.isNotNull()), 0),
        F.when(again.isNotNull(), F.concat(again["name"], F.lit(" is there twice, by its canonical name"))),
        F.when(~shape(line), F.lit("the line is no JSON object of numbers, of objects with numbers and of arrays of these, alone on its line")),
    ])


def canonical(e: Column, a: Analysis) -> list[Column]:
    """The columns that an analysis reads of a line's entries."""
    cols, scalars, triggers = reads(a)
    entry = lambda kind, name: F.get(F.filter(e, lambda x: (x["kind"] == kind) & (x["name"] == name)), 0)
    value = lambda o, p: F.get(F.filter(o, lambda x: x["p"] == p), 0)["x"]
    out = []
    shaped = lambda ps: lambda o: F.struct(*[value(o, p).alias(p) for p in ps])
    for b, ps in cols.items():
        objects = entry("collection", b)["objects"]
        out.append(F.transform(F.coalesce(objects, F.array().cast("array<array<struct<p:string,x:double>>>")), shaped(ps)).alias(b))
    met = entry("met", "MET")
    part = F.get(met["objects"], 0)
    out.append(F.when(met.isNotNull(), F.struct(F.coalesce(met["number"], value(part, "pt")).alias("pt"), value(part, "phi").alias("phi"))).alias("met"))
    out += [entry("weight" if n == "weight" else "scalar", n)["number"].alias(n) for n in (*scalars, "weight")]
    if triggers:
        fired = F.get(entry("triggers", "triggers")["objects"], 0)
        out.append(F.when(fired.isNotNull(), F.struct(*[value(fired, t).alias(t) for t in triggers])).alias("triggers"))
    return out


def _regular() -> str:
    """A pattern of lines that are told sound by their text, but for the order of their collections: known collections, missing
    momentum, triggers and numbers, each once by its canonical name, with all numbers finite and in their domains."""
    gap = r"[ \t]*+"
    size = r"(?:0(?=\.)|[1-9][0-9]{0,14})(?:\.[0-9]{1,20})?(?:[eE][-+]?[0-9]{1,2})?|0(?![0-9.eE])"
    positive, number, flag, null = f"(?:{size})", rf"(?:-(?!0(?!\.))(?:{size})|{size})", r"[01](?:\.0)?(?![0-9.eE])", "(?-i:null)"
    any_of = "|".join
    listed = lambda one, end="}", start='"': rf"(?:{one}{gap}(?:,{gap}(?=\{start})|(?=\{end})))*+"

    def key(names: str, ahead: str) -> str:
        """A key of which no other spelling follows."""
        return rf'(?:{names})"(?!{ahead}"(?:{names})")'

    def fields(group: str) -> str:
        spelled = {c: any_of([c, *(k for k, v in PROPERTIES.items() if v == c)]) for c in sorted({*PROPERTIES.values(), "pt"})}
        known = any_of([*spelled.values(), *sorted(TAGS)])
        keys = lambda ns: f"(?:{any_of(key(n, '[^}]*') for n in ns)}){gap}:{gap}"
        large = keys(n for c, n in spelled.items() if c in ("pt", "e")) + f"(?:{positive}|{null})"
        tags = keys(sorted(TAGS)) + f"(?:{flag}|{null})"
        plain = keys(n for c, n in spelled.items() if c not in ("pt", "e")) + f"(?:{number}|{null})"
        other = rf'(?!(?:{known})")(?<{group}>[a-z][a-z0-9_]*+)"(?![^}}]*"\k<{group}>"){gap}:{gap}(?:{number}|{null})'
        one = f'"(?:{any_of([large, tags, plain, other])})'
        return rf"\{{{gap}{listed(one)}{gap}\}}"

    collections = [any_of(k for k, v in BY_SPELLING.items() if v == c) for c in COLLECTIONS]
    met, scalars = any_of(sorted(MET)), sorted(SCALARS)
    named = any_of([*collections, met, *scalars, "triggers"])
    fired = rf'"(?<flag>[a-z][a-z0-9_]*+)"(?![^}}]*"\k<flag>"){gap}:{gap}{flag}'
    some = [
        rf"(?:{any_of(key(n, '.*') for n in collections)}){gap}:{gap}\[{gap}{listed(fields('own'), ']', '{')}{gap}\]",
        rf"{key(met, '.*')}{gap}:{gap}(?:{positive}|{fields('met')})",
        rf"{key('triggers', '.*')}{gap}:{gap}\{{{gap}{listed(fired)}{gap}\}}",
        rf"(?:{any_of(key(n, '.*') for n in scalars)}){gap}:{gap}{positive}",
        rf'(?!(?:{named})")(?<key>[a-z][a-z0-9_]*+)"(?!.*"\k<key>"){gap}:{gap}{number}',
    ]
    one = f'"(?:{any_of(some)})'
    return rf"(?i)^\{{{gap}{listed(one)}{gap}\}}$"


REGULAR = _regular()


def _spellings(a: Analysis) -> tuple[dict[str, list[str]], str]:
    """The spellings of properties that an analysis reads, and the schema of a regular line in small letters."""
    cols, scalars, triggers = reads(a)
    spelled = {p: [p, *(k for k, v in PROPERTIES.items() if v == p)] for ps in ([["pt", "phi"], *cols.values()]) for p in ps}
    flat = lambda ps: "struct<" + ", ".join(f"`{s}`: double" for p in ps for s in spelled[p]) + ">"
    kinds = {s: f"array<{flat(cols.get(b, ['pt']))}>" for s, b in BY_SPELLING.items()} | {s: "string" for s in sorted(MET)}
    kinds |= {n: "double" for n in (*scalars, "weight")}
    if triggers:
        kinds["triggers"] = "struct<" + ", ".join(f"`{t}`: double" for t in triggers) + ">"
    return spelled, "struct<" + ", ".join(f"`{n}`: {k}" for n, k in kinds.items()) + ">"


def _regular_columns(j: Column, a: Analysis) -> list[Column]:
    """``canonical`` of a regular line that is read by its schema."""
    cols, scalars, triggers = reads(a)
    spelled, _ = _spellings(a)
    first = lambda x, names: F.coalesce(*[x[n] for n in names])
    shaped = lambda ps: lambda o: F.struct(*[first(o, spelled[p]).alias(p) for p in ps])
    out = []
    for b, ps in cols.items():
        kind = "array<struct<" + ", ".join(f"`{p}`: double" for p in ps) + ">>"
        out.append(F.coalesce(F.transform(first(j, [s for s, n in BY_SPELLING.items() if n == b]), shaped(ps)), F.array().cast(kind)).alias(b))
    met = first(j, sorted(MET))
    part = F.when(met.startswith("{"), F.from_json(met, "struct<pt: double, phi: double>"))
    out.append(F.when(met.isNotNull(), F.struct(F.when(met.startswith("{"), part["pt"]).otherwise(met.try_cast("double")).alias("pt"), part["phi"].alias("phi"))).alias("met"))
    out += [j[n].alias(n) for n in (*scalars, "weight")]
    if triggers:
        out.append(F.when(j["triggers"].isNotNull(), F.struct(*[j["triggers"][t].alias(t) for t in triggers])).alias("triggers"))
    return out


def _in_order(j: Column) -> Column:
    """Whether each collection of a regular line falls in pt, elements without one aside."""
    out = F.lit(True)
    for b in COLLECTIONS:
        pts = F.array_compact(F.coalesce(*[j[s] for s, n in BY_SPELLING.items() if n == b])["pt"])
        out = out & F.coalesce(F.sort_array(pts, asc=False) == pts, F.lit(True))
    return out


def parse_events(lines: DataFrame, a: Analysis, text: str = "value", key: str | None = None, refuse: bool = True, line: str | None = None, file: str | None = None, columns: bool = True) -> DataFrame:
    """Events from a table of JSON lines, batch or streaming; blank lines are left out. ``event`` is
    the column ``key``, or else a number that rises with the input's order but isn't dense (in the
    first partition it is the line's number, from 0). A line that can't be an event raises with
    that number (or that of the column ``line``, and the name in ``file``) when it is read; without ``refuse``,
    ``_parse_error`` says what is wrong with it, which ``check_events`` raises for the first such line. Without ``columns``, nothing else is told of an event."""
    number = F.col(key) if key else F.monotonically_increasing_id()
    at = F.col(line) if line else F.lit(None).cast("long")
    where = F.col(file) if file else F.lit(None).cast("string")
    x = lines.select(number.alias("event"), F.btrim(F.col(text), F.lit(BLANK)).alias("t"), at.alias("_line"), where.alias("_file")).where(~blank(F.col("t")))
    # Exploded, not selected: a filter would be pushed below a selection, and decode lines twice.
    # Regular lines are read by a schema; only others are taken apart key by key.
    j = F.when(F.col("t").rlike(REGULAR), F.from_json(F.lower("t"), _spellings(a)[1]))
    x = x.select("event", "t", "_line", "_file", F.explode(F.array(j)).alias("j"))
    x = x.select("event", "t", "_line", "_file", F.explode(F.array(F.when(_in_order(F.col("j")), F.col("j")))).alias("j"))
    regular = F.col("j").isNotNull()
    x = x.select("event", "t", "_line", "_file", "j", F.explode(F.array(F.when(~regular, entries(F.col("t"))))).alias("e"))
    said = F.when(~regular, line_error(F.col("t"), F.col("e")))
    told = F.when(said.isNotNull(), F.concat(said, F.lit(": "), F.substring("t", 1, 80)))
    collections, scalars, triggers = reads(a)
    names = [*collections, "met", *scalars, "weight", *(["triggers"] if triggers else [])]
    cols = [F.when(regular, r).otherwise(c).alias(n) for n, r, c in zip(names, _regular_columns(F.col("j"), a), canonical(F.col("e"), a), strict=True)] if columns else []
    x = x.select("event", "_line", "_file", F.inline(F.array(F.struct(*cols, told.alias("_parse_error")))))
    if not refuse:
        return x.drop(*[c for c, given in (("_line", line), ("_file", file)) if not given])
    place = F.concat(F.lit("line "), F.coalesce("_line", "event").cast("string"), F.coalesce(F.concat(F.lit(" of "), "_file"), F.lit("")))
    sound = F.when(F.col("_parse_error").isNull(), F.lit(True)).otherwise(F.raise_error(F.concat(place, F.lit(": "), F.col("_parse_error"))).cast("boolean"))
    return x.where(sound).drop("_parse_error", "_line", "_file")


def read_jsonl(spark: SparkSession, path: str, a: Analysis, refuse: bool = True) -> DataFrame:
    """Events of text files in one pass; numbers rise but aren't dense (see ``read_numbered``)."""
    return parse_events(spark.read.text(path), a, refuse=refuse)


def read_numbered(spark: SparkSession, path: str | list[str], a: Analysis, refuse: bool = True) -> DataFrame:
    """Events whose ``event`` is 0..n-1 in input order, at any number of partitions, with errors told by file and line (from 1).
    With ``refuse``, one pass finds the first bad line of all files, in their order, and raises for it."""
    from .validate import LoadError

    lines = numbered_lines(spark, path)
    x = parse_events(lines, a, key="ordinal", refuse=False, line="line", file="file")
    if not refuse:
        return x
    told = parse_events(lines, a, key="ordinal", refuse=False, line="line", file="file", columns=False)
    bad = told.where("_parse_error is not null").agg(F.min(F.struct("event", "_line", "_file", "_parse_error")).alias("b")).first()["b"]
    if bad is not None:
        raise LoadError(f"line {bad['_line']} of {bad['_file']}: {bad['_parse_error']}")
    return x.drop("_parse_error", "_line", "_file")


__all__ = ["parse_events", "read_jsonl", "read_numbered", "reads"]
