"""The interface: check, run, objects, dot, verify and ingest."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from .language import LanguageError, parse, resolve
from .language.model import Analysis, Diagnostic
from .operators import bin_flow, counts, cutflow, histograms, membership
from .operators.cutflow import document
from .operators.histograms import documents
from .operators.membership import results
from .plans.planner import Plan, plan
from .prover.verdicts import verify
from .sources.jsonl import reads
from .sources.profiles import ingest
from .sources.sinks import cutflow_text
from .sources.validate import refusing


def check(source: str) -> list[Diagnostic]:
    """Every diagnostic of a source, errors and warnings."""
    return resolve(parse(source)).diagnostics


def analyse(source: str) -> Analysis:
    a = resolve(parse(source))
    if a.errors:
        raise LanguageError(a.errors)
    return a


@dataclass
class Result:
    """Results of one run; each is a lazy DataFrame over the same planned events."""

    plan: Plan

    @property
    def membership(self) -> DataFrame:
        return membership(self.plan)

    @property
    def results(self) -> DataFrame:
        return results(self.plan)

    @property
    def counts(self) -> DataFrame:
        return counts(self.plan)

    @property
    def cutflow(self) -> DataFrame:
        return cutflow(self.plan)

    @property
    def bins(self) -> DataFrame:
        return bin_flow(self.plan)

    @property
    def histograms(self) -> DataFrame:
        return histograms(self.plan)

    def cutflow_text(self) -> str:
        return cutflow_text(self.cutflow.collect())

    def cutflow_json(self) -> dict:
        """Cutflow and bin flow as one document (version 1 of the JSON form)."""
        return document(self.plan, self.cutflow.collect(), self.bins.collect())

    def histogram_json(self) -> dict:
        return {"version": 2, "histograms": documents(self.plan)}


def run(source: str | Analysis, events: DataFrame, exact: bool = True, decisive: bool = False, check: bool = True) -> Result:
    """Plan an analysis over canonical events, batch or streaming; ``decisive`` for three-valued membership. An event that
    breaches what the language takes for granted (order in pt, domains) raises, unless ``check`` is off because a loader
    has checked it. Only what the analysis reads is checked."""
    a = source if isinstance(source, Analysis) else analyse(source)
    if check:
        bases, scalars, triggers = reads(a)
        events = refusing(events, {*bases, *scalars, "met", "weight", *(["triggers"] if triggers else [])})
    return Result(plan(a, events, exact, decisive))


def objects(source: str) -> list[dict]:
    """Each object with the chain of collections that it is made of."""
    a, out = analyse(source), []
    for low, c in a.objects.items():
        chain, at = [], c
        while at[0] in ("filter", "sort", "slice"):
            chain.append(at[0])
            at = at[1]
        out.append({"object": a.spelling.get(low, low), "chain": chain, "source": at[1] if at[0] == "base" else at[0], "same_as": [a.spelling.get(o, o) for o, d in a.objects.items() if d == c and o != low]})
    return out


def dot(source: str) -> str:
    """The analysis as a flow chart in DOT: objects by what they are made of, regions by their steps."""
    a, out = analyse(source), ["digraph analysis {", "  rankdir=TB;"]
    quote = lambda s: '"' + s.replace("\\", "\\\\").replace('"', '\\"') + '"'
    for o in objects(source):
        out.append(f"  {quote(str(o['source']))} -> {quote(o['object'])} [label={quote(' '.join(o['chain']))}];")
    for r in a.regions.values():
        last = None
        for k, s in enumerate(r.steps):
            here = f"{r.name}:{k}"
            out.append(f"  {quote(here)} [shape=box,label={quote(s.label)}];")
            if last:
                out.append(f"  {quote(last)} -> {quote(here)};")
            last = here
    return "\n".join([*out, "}"]) + "\n"


__all__ = ["Result", "analyse", "check", "dot", "ingest", "objects", "run", "verify"]
