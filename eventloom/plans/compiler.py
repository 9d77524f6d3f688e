"""The resolved model compiled to Spark columns.

A number becomes ``(value, error)`` and a predicate ``(truth, error)``: a soft non-value is a
null value, a predicate is never null, and an error is a message. Where a node cannot fail
its error is None at compile time, so no error column exists at all. Comparisons with a
non-value are false; operands evaluate in order, so what a decisive one hides isn't an error.

Collections are columns of their own, added stage by stage in order of dependency, so each
array is built once however many regions read it. Everything is row-local: no stage
shuffles. No stage filters either, since a filter would be pushed below the stages and
compute arrays anew.
"""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import kinematics as K
from ..functions.externals import REGISTRY, lookup
from ..language.model import Analysis, is_predicate, walk

Value = tuple[Column, Column | None]
#: An exact DECIMAL with its precision and scale.
Exact = tuple[Column, int, int]
#: DECIMAL types that leaves are cast to, by precision and scale, the widest first; products take narrower ones.
WIDEST = 38
LEAVES = ((36, 20), (34, 18), (32, 16), (30, 14), (24, 10), (18, 14), (18, 10), (18, 6), (12, 8), (12, 5), (9, 3))
COLLECTIONS = {"filter", "union", "sort", "slice", "combine", "project"}
OPS = {"<": "__lt__", ">": "__gt__", "<=": "__le__", ">=": "__ge__", "==": "__eq__", "!=": "__ne__"}


def none() -> Column:
    return F.lit(None).cast("double")


class TooWide(Exception):
    """A product or sum doesn't fit DECIMAL."""


def times(a: Exact | None, b: Exact | None) -> Exact | None:
    """The exact product; None stands for one."""
    if a is None or b is None:
        return a or b
    p, s = a[1] + b[1] + 1, a[2] + b[2]
    if p > WIDEST:
        raise TooWide
    return a[0] * b[0], p, s


def plus(a: Exact, b: Exact, op: str) -> Exact:
    s = max(a[2], b[2])
    p = max(a[1] - a[2], b[1] - b[2]) + s + 1
    if p > WIDEST:
        raise TooWide
    return (a[0] + b[0] if op == "+" else a[0] - b[0]), p, s


def first_error(*errors: Column | None) -> Column | None:
    got = [e for e in errors if e is not None]
    return None if not got else got[0] if len(got) == 1 else F.coalesce(*got)


class Compiler:
    def __init__(self, analysis: Analysis, schema: T.StructType, exact: bool = True, decisive: bool = False):
        self.a, self.exact, self.decisive = analysis, exact, False
        self.columns = {f.name.lower(): f for f in schema.fields}
        self.names: dict[tuple, str] = {}  # collection to its column
        self.faulty: set[tuple] = set()  # collections with an error column
        self.stages: list[dict[str, Column]] = []
        self.regions: dict[str, tuple[str, bool]] = {}  # region to its column, whether it can fail
        for c in self.needed():
            self.stage(c)
        self.decisive = decisive  # of regions alone: collections are built in order

    # -- collections ----------------------------------------------------------------
    def needed(self) -> list[tuple]:
        """Collections that regions read, each after those it is made of."""
        out: dict[tuple, None] = {}

        def visit(node) -> None:
            for x in node:
                if isinstance(x, tuple):
                    visit(x)
            if node and node[0] in COLLECTIONS and isinstance(node[0], str):
                out[node] = None

        for r in self.a.regions.values():
            for s in r.steps:
                visit(s.node or ())
                visit(s.histo.exprs if s.histo else ())
        return list(out)

    def stage(self, c: tuple) -> None:
        name = f"_c{len(self.names)}"
        value, error = self.collection(c)
        self.names[c] = name
        cols = {name: value}
        if error is not None:
            cols[f"{name}e"] = error
            self.faulty.add(c)
        self.stages.append(cols)

    def fields(self, c: tuple) -> list[str]:
        """Property names that elements of a collection may have, in a fixed order."""
        kind = c[0]
        if kind == "base":
            f = self.columns.get(c[1])
            return [x.name for x in f.dataType.elementType.fields] if f is not None and isinstance(f.dataType, T.ArrayType) else []
        if kind in ("filter", "sort", "slice"):
            return self.fields(c[1])
        if kind == "union":
            return list(dict.fromkeys(x for m in c[1] for x in self.fields(m)))
        if kind == "project":
            slots = dict(c[1][2])
            return self.fields(slots[c[2]]) if c[2] in slots else ["pt", "eta", "phi", "m", "e"]
        return []

    def array(self, c: tuple) -> Column:
        if c in self.names:
            return F.col(self.names[c])
        if c[0] == "base" and c[1] in self.columns and isinstance(self.columns[c[1]].dataType, T.ArrayType):
            f = self.columns[c[1]]
            return F.coalesce(F.col(f.name), F.array().cast(f.dataType))
        return F.array().cast("array<struct<pt:double>>")

    def fault(self, c: tuple) -> Column | None:
        if c in self.faulty:
            return F.col(f"{self.names[c]}e")
        return None

    def element(self, c: tuple):
        return {x.lower(): x for x in self.fields(c)}

    def over(self, c: tuple, env: dict, body, key: str):
        """``body`` in the scope of an element of c; its array and what it may raise."""
        seen: list[Column | None] = []
        env = env | {f"{key}_of": c}

        def lam(x):
            return body(env | {key: x})

        probe = body(env | {key: F.col("_probe")})
        seen.append(probe[1])
        return lam, seen[0] is not None

    def collection(self, c: tuple) -> Value:
        kind = c[0]
        if kind == "filter":
            src, p = self.array(c[1]), c[2]
            lam, fails = self.over(c[1], {}, lambda env: self.truth(p, env), "this")
            error = self.fault(c[1])
            if fails:
                error = first_error(error, F.get(F.filter(F.transform(src, lambda x: lam(x)[1]), lambda e: e.isNotNull()), 0))
            return F.filter(src, lambda x: lam(x)[0]), error
        if kind == "union":
            names = self.fields(c)
            return F.concat(*[self.shaped(m, names) for m in c[1]]), first_error(*map(self.fault, c[1]))
        if kind == "sort":
            _, src, key, down = c
            lam, fails = self.over(src, {}, lambda env: self.number(key, env), "this")
            a, error = self.array(src), self.fault(src)
            if fails:
                error = first_error(error, F.get(F.filter(F.transform(a, lambda x: lam(x)[1]), lambda e: e.isNotNull()), 0))
            # Rising: missing keys last; falling is the whole order reversed, so missing first.
            rank = lambda x, i: F.struct((lam(x)[0].isNull() != F.lit(down)).alias("none"), F.coalesce(-lam(x)[0] if down else lam(x)[0], F.lit(0.0)).alias("key"), i.alias("i"), x.alias("x"))
            return F.transform(F.sort_array(F.transform(a, rank)), lambda r: r["x"]), error
        if kind == "slice":
            _, src, a, b = c
            n = F.size(self.array(src))
            clamp = lambda i: F.least(F.lit(i), n) if i >= 0 else F.greatest(n + i, F.lit(0))
            lo, hi = clamp(a), n if b is None else clamp(b)
            return F.slice(self.array(src), lo + 1, F.greatest(hi - lo, F.lit(0))), self.fault(src)
        if kind == "combine":
            return self.combination(c)
        _, combo, member = c
        slots = dict(combo[2])
        if member in slots:
            return F.transform(self.array(combo), lambda t: t[member]), self.fault(combo)
        p = dict(combo[3])[member]
        one = lambda t: self.lorentz(p, {"tuple": t, "combo": combo})[0]
        made = F.transform(self.array(combo), lambda t: F.struct(*[K.of_vector(one(t), x).alias(x) for x in ("pt", "eta", "phi", "m", "e")]))
        return F.filter(made, lambda v: v["pt"].isNotNull()), self.fault(combo)

    def shaped(self, c: tuple, names: list[str]) -> Column:
        have = self.element(c)
        if not names:
            return self.array(c)
        if not have:
            return F.array().cast("array<struct<" + ",".join(f"`{n}`:double" for n in names) + ">>")
        return F.transform(self.array(c), lambda x: F.struct(*[(x[have[n.lower()]].cast("double") if n.lower() in have else none()).alias(n) for n in names]))

    def combination(self, c: tuple) -> Value:
        """Tuples of one element of each member. Where the cuts can't fail, each is tested as soon as all members that it reads
        are chosen, and so is distinctness, so that few tuples are made of many elements."""
        _, distinct, slots, _, test = c
        same = distinct and len({s for _, s in slots}) == 1
        mark = lambda s: F.transform(self.array(s), lambda x, i: F.struct(i.alias("i"), x.alias("x")))
        env = lambda t: {"tuple": t, "combo": c}
        fails = test != ("const", True) and self.truth(test, env(F.col("_probe")))[1] is not None
        parts = () if fails or test == ("const", True) else test[1] if test[0] == "and" else (test,)
        names = {n: k for k, (n, _) in enumerate(slots)}
        last = lambda part: max((names[n[1]] for n in walk(part) if n[0] == "binder"), default=len(slots) - 1)
        at = [[x for x in parts if last(x) == k] for k in range(len(slots))]

        def fits(k: int, chosen: list[Column], y: Column) -> Column:
            t = {n: z["x"] for (n, _), z in zip(slots, [*chosen, y], strict=False)}
            apart = [~self.alike(t, slots[k], slots[j]) for j in range(k)] if distinct else []
            later = [y["i"] > chosen[-1]["i"]] if same and chosen else []
            return reduce(lambda a, b: a & b, [*later, *[self.truth(x, env(t))[0] for x in at[k]], *apart], F.lit(True))

        def nest(k: int, chosen: list[Column]) -> Column:
            items = mark(slots[k][1])
            if at[k] or distinct and k:
                items = F.filter(items, lambda y: fits(k, chosen, y))
            if k == len(slots) - 1:
                return F.transform(items, lambda y: F.struct(*[z["x"].alias(n) for (n, _), z in zip(slots, [*chosen, y], strict=True)]))
            return F.flatten(F.transform(items, lambda y: nest(k + 1, [*chosen, y])))

        tuples = nest(0, [])
        error = first_error(*[self.fault(s) for _, s in slots])
        if fails:
            error = first_error(error, F.get(F.filter(F.transform(tuples, lambda t: self.truth(test, env(t))[1]), lambda e: e.isNotNull()), 0))
            tuples = F.filter(tuples, lambda t: self.truth(test, env(t))[0])
        return tuples, error

    def alike(self, t: Column | dict[str, Column], a: tuple, b: tuple) -> Column:
        x, y, out = self.element(a[1]), self.element(b[1]), F.lit(True)
        for p in ("pt", "eta", "phi", "m"):
            u = t[a[0]][x[p]] if p in x else none()
            v = t[b[0]][y[p]] if p in y else none()
            out = out & u.eqNullSafe(v)
        return out

    # -- particles --------------------------------------------------------------------
    def struct(self, p: tuple, env: dict) -> tuple[Column | None, dict, Column | None]:
        """A particle's struct, its fields, and what reading it may raise."""
        kind = p[0]
        if kind == "elem":
            a, i = self.array(p[1]), p[2]
            return (F.get(a, F.lit(i)) if i >= 0 else F.try_element_at(a, F.lit(i))), self.element(p[1]), self.fault(p[1])
        if kind in ("this", "item"):
            if kind not in env:
                return None, {}, F.lit(f"{kind} is used outside its block")
            return env[kind], self.element(env[f"{kind}_of"]), None
        if kind == "binder":
            if "tuple" not in env:
                return None, {}, F.lit("a member is used outside its combination")
            return env["tuple"][p[1]], self.element(dict(env["combo"][2])[p[1]]), None
        return None, {}, F.lit("an unindexed collection is no single particle")

    def read(self, p: tuple, name: str, env: dict) -> Value:
        if p == ("met",):
            return self.met(name)
        s, have, error = self.struct(p, env)
        return (none() if s is None or name not in have else s[have[name]].cast("double")), error

    def met(self, name: str) -> Value:
        f = self.columns.get("met")
        if f is None:
            return none(), F.lit("the event has no missing momentum")
        if not isinstance(f.dataType, T.StructType):
            v = F.col(f.name).cast("double") if name == "pt" else none()
        else:
            have = {x.name.lower(): x.name for x in f.dataType.fields}
            v = F.col(f.name)[have[name]].cast("double") if name in have else none()
        return v, F.when(F.col(f.name).isNull(), F.lit("the event has no missing momentum"))

    def lorentz(self, p: tuple, env: dict) -> tuple[tuple[Column, ...], Column | None]:
        if p[0] == "sum":
            got = [self.lorentz(x, env) for x in p[1]]
            return K.total([v for v, _ in got]), first_error(*[e for _, e in got])
        if p == ("met",):
            (pt, e), (phi, _) = self.met("pt"), self.met("phi")
            return K.transverse(pt, phi), e
        got = [self.read(p, n, env) for n in ("pt", "eta", "phi", "m")]
        return K.vector(*[v for v, _ in got]), first_error(got[0][1])

    def angles(self, p: tuple, env: dict) -> tuple[Column, Column, Column | None]:
        if p[0] == "sum":
            v, e = self.lorentz(p, env)
            return K.of_vector(v, "eta"), K.of_vector(v, "phi"), e
        if p == ("met",):
            phi, e = self.met("phi")
            return none(), phi, e
        (eta, e), (phi, _) = self.read(p, "eta", env), self.read(p, "phi", env)
        return eta, phi, e

    def separation(self, fn: str, a: tuple, b: tuple, env: dict) -> Value:
        (eta1, phi1, e1), (eta2, phi2, e2) = self.angles(a, env), self.angles(b, env)
        v = {"dR": lambda: K.delta_r(eta1, phi1, eta2, phi2), "dPhi": lambda: K.delta_phi(phi1, phi2), "dEta": lambda: eta1 - eta2}[fn]()
        return K.finite(v), first_error(e1, e2)

    # -- three-valued membership ------------------------------------------------------------
    def unsettled(self, *operands: Value) -> Column | None:
        """The first error of operands; where a decision counts wherever it stands, none beside an operand without a value."""
        said = first_error(*[e for _, e in operands])
        if said is None or not self.decisive:
            return said
        soft = [v.isNull() if e is None else v.isNull() & e.isNull() for v, e in operands]
        return F.when(~reduce(lambda x, y: x | y, soft), said)

    def guarded(self, error: Column | None, a: Value, b: Value) -> Column | None:
        """A guard's error, which doesn't matter to a decision where both branches say the same."""
        if error is None or not self.decisive:
            return error
        clean = [e.isNull() for _, e in (a, b) if e is not None]
        return F.when(~reduce(lambda x, y: x & y, clean, a[0].eqNullSafe(b[0])), error)

    # -- numbers ------------------------------------------------------------------------
    def number(self, n: tuple, env: dict) -> Value:
        kind = n[0]
        if kind == "num":
            return F.lit(float(n[1])), None
        if kind in ("scalar", "trigger"):
            return self.datum(kind, n[1])
        if kind == "met_prop":
            return self.met(n[1])
        if kind == "size":
            return F.size(self.array(n[1])).cast("double"), self.fault(n[1])
        if kind == "prop":
            if n[1][0] == "sum":
                v, e = self.lorentz(n[1], env)
                return K.of_vector(v, n[2]), e
            return self.read(n[1], n[2], env)
        if kind == "angle":
            return self.separation(*n[1:], env)
        if kind == "pair":
            _, fn, a, b = n
            all_ = F.flatten(F.transform(self.array(a), lambda x: F.transform(self.array(b), lambda y: self.between(fn, a, b, x, y))))
            return F.array_min(F.filter(all_, lambda v: v.isNotNull())), first_error(self.fault(a), self.fault(b))
        if kind == "arith":
            (a, e1), (b, e2) = self.number(n[2], env), self.number(n[3], env)
            v = {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: K.finite(F.try_divide(a, b)), "^": lambda: K.finite(F.pow(a, b))}[n[1]]()
            return v, self.unsettled((a, e1), (b, e2))
        if kind in ("neg", "abs"):
            v, e = self.number(n[1], env)
            return (-v if kind == "neg" else F.abs(v)), e
        if kind == "fn":
            v, e = self.number(n[2], env)
            return K.finite({"sqrt": F.sqrt, "cos": F.cos, "sin": F.sin, "tan": F.tan, "log": F.log}[n[1]](v)), e
        if kind in ("least", "greatest"):
            got = [self.number(x, env) for x in n[1]]
            some = reduce(lambda a, b: a | b, [v.isNull() for v, _ in got])
            return F.when(some, None).otherwise(getattr(F, kind)(*[v for v, _ in got])), self.unsettled(*got)
        if kind == "choose":
            (g, e), (a, ea), (b, eb) = self.truth(n[1], env), self.number(n[2], env), self.number(n[3], env)
            late = F.when(g, ea if ea is not None else F.lit(None).cast("string")).otherwise(eb if eb is not None else F.lit(None).cast("string")) if ea is not None or eb is not None else None
            return F.when(g, a).otherwise(b), first_error(self.guarded(e, (a, ea), (b, eb)), late)
        if kind == "truth":
            b, e = self.truth(n[1], env)
            return b.cast("int").cast("double"), e
        if kind == "defined":
            v, e = self.number(n[1], env)
            return (v.isNotNull() & (e.isNull() if e is not None else F.lit(True))).cast("int").cast("double"), None
        if kind == "fold":
            return self.folded(n, env)
        if kind == "external":
            return self.external(n, env)
        if kind == "bad":
            return none(), F.lit(n[1])
        if is_predicate(n):
            return self.number(("truth", n), env)
        return none(), F.lit(f"{kind} is not a number")

    def datum(self, kind: str, name: str) -> Value:
        f, v = self.columns.get(name), None
        if kind == "trigger" and (t := self.columns.get("triggers")) is not None and isinstance(t.dataType, T.StructType):
            have = {x.name.lower(): x.name for x in t.dataType.fields}
            v = F.col(t.name)[have[name]].cast("double") if name in have else None
        if v is None and f is not None and isinstance(f.dataType, (T.NumericType, T.BooleanType)):
            v = F.col(f.name).cast("double")
        said = F.lit(f"the event has no {name}")
        return (none(), said) if v is None else (v, F.when(v.isNull(), said))

    def between(self, fn: str, a: tuple, b: tuple, x: Column, y: Column) -> Column:
        return self.separation(fn, ("this",), ("item",), {"this": x, "this_of": a, "item": y, "item_of": b})[0]

    def folded(self, n: tuple, env: dict) -> Value:
        _, kind, c, body = n
        lam, fails = self.over(c, env, lambda e: self.number(body, e), "item")
        values, error = F.transform(self.array(c), lambda x: lam(x)[0]), self.fault(c)
        if fails:
            said = F.get(F.filter(F.transform(self.array(c), lambda x: lam(x)[1]), lambda e: e.isNotNull()), 0)
            soft = F.exists(self.array(c), lambda x: lam(x)[0].isNull() & lam(x)[1].isNull())
            error = first_error(error, F.when(~soft, said) if self.decisive else said)
        if kind == "sum":
            return F.aggregate(values, F.lit(0.0), lambda a, v: a + v), error
        best = F.array_min(values) if kind == "min" else F.array_max(values)
        return F.when(F.exists(values, lambda v: v.isNull()), None).otherwise(best), error

    def external(self, n: tuple, env: dict) -> Value:
        known = REGISTRY.get(n[1]) or (lookup(self.a.tables[n[1]]) if n[1] in self.a.tables else None)
        if known is None:
            return none(), F.lit(f"function {n[1]} has no definition here")
        args, errors = [], []
        for a in n[2]:
            if a[0] == "whole":
                args.append(self.array(a[1]))
                errors.append(self.fault(a[1]))
            elif a[0] in ("elem", "this", "item", "binder"):
                s, _, e = self.struct(a, env)
                args.append(s)
                errors.append(e)
            elif a == ("met",):
                args.append(F.col(self.columns["met"].name) if "met" in self.columns else F.lit(None))
                errors.append(self.met("pt")[1])
            else:
                v, e = self.number(a, env)
                args.append(v)
                errors.append(e)
        return K.finite(known.column(*args).cast("double")), first_error(*errors)

    # -- predicates ---------------------------------------------------------------------
    def truth(self, n: tuple, env: dict) -> Value:
        kind = n[0]
        if kind == "const":
            return F.lit(n[1]), None
        if kind == "cmp":
            return self.compared(n, env)
        if kind == "band":
            v, e = self.number(n[2], env)
            lo, hi = F.lit(float(n[3][1])), F.lit(float(n[4][1]))
            test = (v >= lo) & (v <= hi) if n[1] else (v <= lo) | (v >= hi)
            return F.coalesce(test, F.lit(False)), e
        if kind in ("and", "or"):
            return self.junction(kind, [self.truth(x, env) for x in n[1]])
        if kind == "not":
            b, e = self.truth(n[1], env)
            return ~b, e
        if kind == "if":
            (g, e), (a, ea), (b, eb) = (self.truth(x, env) for x in n[1:])
            late = F.when(g, ea if ea is not None else F.lit(None).cast("string")).otherwise(eb if eb is not None else F.lit(None).cast("string")) if ea is not None or eb is not None else None
            return F.when(g, a).otherwise(b), first_error(self.guarded(e, (a, ea), (b, eb)), late)
        if kind == "region":
            name, fails = self.regions[n[1]]
            return F.col(name), F.col(f"{name}e") if fails else None
        if kind in ("any", "all"):
            _, c, body = n
            lam, fails = self.over(c, env, lambda e: self.truth(body, e), "item")
            a, error = self.array(c), self.fault(c)
            decisive = (lambda x: lam(x)[0]) if kind == "any" else (lambda x: ~lam(x)[0])
            if not fails:
                return (F.exists(a, decisive) if kind == "any" else ~F.exists(a, decisive)), error
            # A decisive element that doesn't fail settles it; else any failure shows.
            clean = F.exists(a, lambda x: decisive(x) & lam(x)[1].isNull())
            said = F.get(F.filter(F.transform(a, lambda x: lam(x)[1]), lambda e: e.isNotNull()), 0)
            return (clean if kind == "any" else ~clean), first_error(error, F.when(~clean, said))
        if kind == "pairs":
            return self.pairs(n, env)
        if kind == "nonzero":
            v, e = self.number(n[1], env)
            return F.coalesce(v != 0, F.lit(False)), e
        if kind == "bad":
            return F.lit(False), F.lit(n[1])
        return self.truth(("nonzero", n), env)

    def junction(self, kind: str, parts: list[Value]) -> Value:
        out, error = parts[0]
        if self.decisive:
            decides = [(~b if kind == "and" else b) if e is None else e.isNull() & (~b if kind == "and" else b) for b, e in parts]
            said = first_error(*[e for _, e in parts])
            join = (lambda x, y: x & y) if kind == "and" else (lambda x, y: x | y)
            return reduce(join, [b for b, _ in parts]), None if said is None else F.when(~reduce(lambda x, y: x | y, decides), said)
        for b, e in parts[1:]:
            if e is not None:
                open_ = out if kind == "and" else ~out
                late = F.when(open_, e)
                error = late if error is None else F.coalesce(error, late)
            out = out & b if kind == "and" else out | b
        return out, error

    def compared(self, n: tuple, env: dict) -> Value:
        _, op, x, y = n
        (a, e1), (b, e2) = self.number(x, env), self.number(y, env)
        test = getattr(a, OPS[op])(b)
        if self.exact and any(m[0] == "arith" for m in walk((x, y))):
            exact = self.settled(op, x, y, env)
            if exact is not None:
                test = F.coalesce(exact, test)
        return F.coalesce(test, F.lit(False)), self.unsettled((a, e1), (b, e2))

    def ratio(self, n: tuple, env: dict, leaf: tuple[int, int]) -> tuple[Exact, Exact | None] | None:
        """A number as an exact DECIMAL over another, where it is made of leaves and literals by sums, products and
        quotients; its value is null where a leaf doesn't fit the type. None for other shapes, and where DECIMAL is too narrow.
        A double casts by its shortest decimal form."""
        kind = n[0]
        if kind == "arith" and n[1] in "+-*/":
            a, b = self.ratio(n[2], env, leaf), self.ratio(n[3], env, leaf)
            if a is None or b is None:
                return None
            (an, ad), (bn, bd) = a, b
            if n[1] == "*":
                return times(an, bn), times(ad, bd)
            if n[1] == "/":
                return times(an, bd), times(ad, bn)
            return plus(times(an, bd), times(bn, ad), n[1]), times(ad, bd)
        if kind == "neg":
            a = self.ratio(n[1], env, leaf)
            return None if a is None else ((-a[0][0], *a[0][1:]), a[1])
        if kind == "num":
            d = Decimal(repr(float(n[1])))
            digits, power = d.as_tuple().digits, d.as_tuple().exponent
            scale = max(0, -power)
            precision = max(len(digits) + max(0, power), scale)
            return None if precision > WIDEST else ((F.lit(str(d)).cast(f"decimal({precision},{scale})"), precision, scale), None)
        if kind in ("scalar", "trigger", "met_prop", "size") or kind == "prop" and n[1][0] != "sum":
            v = self.number(n, env)[0]
            d = v.try_cast(f"decimal({leaf[0]},{leaf[1]})")
            return (F.when(d.cast("double") == v, d), *leaf), None
        return None

    def settled(self, op: str, x: tuple, y: tuple, env: dict) -> Column | None:
        """An exact comparison by multiplying ratios crosswise, null where a denominator is zero or no type of leaves fits;
        None where the numbers have no ratio. Leaves take the widest types with which all of it fits DECIMAL: of types of one
        width the one with more places after the point first, then, for what that is too small for, the next."""
        tests, ints, scale = [], -1, -1
        for leaf in LEAVES:
            if leaf[0] - leaf[1] <= ints and leaf[1] <= scale:
                continue
            try:
                test = self.crosswise(op, self.ratio(x, env, leaf), self.ratio(y, env, leaf))
            except TooWide:
                continue
            if test is None:
                return None
            tests.append(test)
            ints, scale = max(ints, leaf[0] - leaf[1]), max(scale, leaf[1])
        return F.coalesce(*tests) if tests else None

    def crosswise(self, op: str, a: tuple | None, b: tuple | None) -> Column | None:
        if a is None or b is None:
            return None
        (an, ad), (bn, bd) = a, b
        (u, p, s), (v, q, t) = times(an, bd), times(bn, ad)
        if max(p - s, q - t) + max(s, t) > WIDEST:
            raise TooWide
        test = getattr(u, OPS[op])(v)
        if ad is None and bd is None:
            return test
        sign = lambda d: F.lit(1) if d is None else F.when(d[0] > 0, 1).when(d[0] < 0, -1)
        return F.when(sign(ad) * sign(bd) > 0, test).when(sign(ad) * sign(bd) < 0, getattr(v, OPS[op])(u))

    def pairs(self, n: tuple, env: dict) -> Value:
        _, fn, a, b, op, other = n
        c, e = self.number(other, env)
        error = first_error(e, self.fault(a), self.fault(b))
        test = lambda v: F.coalesce(getattr(v, OPS[op])(c), F.lit(False))
        x, y = self.array(a), self.array(b)
        if op in ("==", "!="):
            all_ = F.flatten(F.transform(x, lambda u: F.transform(y, lambda v: self.between(fn, a, b, u, v))))
            least = F.coalesce(F.array_min(F.filter(all_, lambda v: v.isNotNull())), F.lit(float("inf")))
            return test(least), error
        if op in ("<", "<="):
            return F.exists(x, lambda u: F.exists(y, lambda v: test(self.between(fn, a, b, u, v)))), error
        # For all pairs; a threshold without a value is false even of no pair.
        return F.forall(x, lambda u: F.forall(y, lambda v: test(self.between(fn, a, b, u, v)))) & c.isNotNull(), error


def with_collections(df: DataFrame, c: Compiler) -> DataFrame:
    for cols in c.stages:
        df = df.withColumns(cols)
    return df
