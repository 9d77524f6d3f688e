"""Regions, cutflows, bins and histogram fills as columns over events."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..language.model import Analysis, Step
from .compiler import Compiler, first_error, with_collections

CUTS = ("select", "reject", "inherit", "trigger")


@dataclass
class Plan:
    """Events with a column for each region, and what it takes to read the rest off them.

    For region number r: ``_p{r}`` whether it accepts, ``_e{r}`` its error if it can have one,
    ``_d{r}`` how many of its cuts passed before one failed.
    """

    analysis: Analysis
    events: DataFrame
    compiler: Compiler
    weight: Column

    def cuts(self, low: str) -> list[Step]:
        return [s for s in self.analysis.regions[low].steps if s.kind in CUTS]

    def index(self, low: str) -> int:
        return list(self.analysis.regions).index(low)


def weight_before(steps: list[Step], upto: Step) -> tuple[float, bool]:
    """The product of numeric weights before a step, and whether others were left out."""
    out, part = 1.0, False
    for s in steps:
        if s is upto:
            break
        if s.kind == "weight":
            if s.node[0] == "num":
                out *= float(s.node[1])
            else:
                part = True
    return out, part


def plan(analysis: Analysis, events: DataFrame, exact: bool = True, decisive: bool = False) -> Plan:
    """Evaluation in order, where an error hides what comes after; or, if ``decisive``, three-valued membership: a
    part that decides counts wherever it stands, and an error shows only where none does. Of such a plan
    cutflows say how many cuts pass before the first that doesn't or fails."""
    c = Compiler(analysis, events.schema, exact, decisive)
    df = with_collections(events, c)
    for r, (low, region) in enumerate(analysis.regions.items()):
        got = [c.truth(s.node, {}) for s in region.steps if s.kind in CUTS]
        depth, stop = F.lit(len(got)), None
        for k in range(len(got) - 1, -1, -1):
            b, e = got[k]
            passed = b if e is None else b & e.isNull()
            depth = F.when(~passed, F.lit(k)).otherwise(depth)
            if e is not None or stop is not None:
                later = stop if stop is not None else F.lit(None).cast("string")
                here = F.when(b, later)  # a cut that fails hides what comes after
                stop = here if e is None else F.coalesce(e, here)
        if decisive:
            stop = c.junction("and", got)[1] if got else None
        df = df.withColumn(f"_d{r}", depth)
        cols = {f"_p{r}": F.col(f"_d{r}") == len(got)}
        if stop is not None:
            cols[f"_e{r}"] = stop
        # The parent's columns under the name that `region` nodes use.
        c.regions[low] = (f"_p{r}", stop is not None)
        if stop is not None:
            cols[f"_p{r}e"] = stop
        df = df.withColumns(cols)
    w = F.coalesce(F.col(c.columns["weight"].name).cast("double"), F.lit(1.0)) if "weight" in c.columns else F.lit(1.0)
    return Plan(analysis, df, c, w)


def error_of(p: Plan, low: str) -> Column:
    return F.col(f"_e{p.index(low)}") if p.compiler.regions[low][1] else F.lit(None).cast("string")


def binned(p: Plan, low: str) -> list[tuple[Step, Column, Column]]:
    """For each bin statement: its number (null: outside; for a boolean bin 1 or 0), its error."""
    out = []
    for s in p.analysis.regions[low].steps:
        if s.kind == "bins":
            v, e = p.compiler.number(s.node, {})
            k = F.lit(None).cast("int")
            for i, edge in enumerate(s.edges):
                k = F.when(v >= edge, F.lit(i)).otherwise(k)
            out.append((s, k, e if e is not None else F.lit(None).cast("string")))
        elif s.kind == "bin":
            b, e = p.compiler.truth(s.node, {})
            out.append((s, b.cast("int"), e if e is not None else F.lit(None).cast("string")))
    return out


__all__ = ["CUTS", "Plan", "binned", "error_of", "first_error", "plan", "weight_before"]
