"""One query for each operator of the language over the driver's tables, with its SQL.

A query is a source text; its result is a row for each region (or step, bin or cell). The SQL says the same of the
events by other means: list functions over the same orders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .api import analyse
from .functions.externals import REGISTRY, register, unregister
from .operators import bin_flow, counts, cutflow, histograms, membership
from .plans.planner import plan
from .sources.jsonl import parse_events
from .sources.profiles import ingest
from .sources.tables import EVENTS_SQL, events_from_tables
from .sources.validate import validated

HARD_MET, HARD_HT = "met is null", "ht is null"
GOOD = "object good\n  take Jet\n  select pT(Jet) > 30\n  select abs(eta(Jet)) < 2.4\n"
G = "list_filter(jet, lambda x: x.pt > 30 and abs(x.eta) < 2.4)"
DPHI = "(((({a}) - ({b}) + pi()) % (2 * pi())) + case when ((({a}) - ({b}) + pi()) % (2 * pi())) < 0 then 2 * pi() else 0 end - pi())"


def dphi(a: str, b: str) -> str:
    return DPHI.format(a=a, b=b)


def dr(x: str, y: str) -> str:
    return f"sqrt(({x}.eta - {y}.eta) ^ 2 + {dphi(f'{x}.phi', f'{y}.phi')} ^ 2)"


def vec(parts: list[str], prop: str) -> str:
    """A property of a sum of particles."""
    s = lambda f: "(" + " + ".join(f.replace("$", p) for p in parts) + ")"
    px, py, pz = s("$.pt * cos($.phi)"), s("$.pt * sin($.phi)"), s("$.pt * (exp($.eta) - exp(-$.eta)) / 2")
    e = s("sqrt(($.pt * cos($.phi)) ^ 2 + ($.pt * sin($.phi)) ^ 2 + ($.pt * (exp($.eta) - exp(-$.eta)) / 2) ^ 2 + $.m ^ 2)")
    return {"m": f"sqrt(greatest({e} ^ 2 - ({px} ^ 2 + {py} ^ 2 + {pz} ^ 2), 0))", "pt": f"sqrt({px} ^ 2 + {py} ^ 2)", "e": e}[prop]


#: name: (source, [(region, condition, error condition or "false")])
REGIONS: dict[str, tuple[str, list[tuple[str, str, str]]]] = {
    "select_reject": (GOOD + "region a\n  select size(good) >= 2\nregion b\n  reject size(good) >= 2\n", [("a", f"len({G}) >= 2", "false"), ("b", f"not len({G}) >= 2", "false")]),
    "trigger": ("region a\n  trigger urgent\n", [("a", "urgent = 1", "false")]),
    "inherit": (GOOD + "region a\n  select size(good) >= 1\nregion b\n  a\n  select Jet[0].btag == 1\n", [("a", f"len({G}) >= 1", "false"), ("b", f"len({G}) >= 1 and jet[1].btag = 1", "false")]),
    "region_as_predicate": (GOOD + "region a\n  select size(good) >= 1\nregion b\n  select a and size(good) < 4\n", [("a", f"len({G}) >= 1", "false"), ("b", f"len({G}) between 1 and 3", "false")]),
    "define_statement": (GOOD + "define busy = size(good) >= 3\nregion a\n  busy\n", [("a", f"len({G}) >= 3", "false")]),
    "comparisons": ("region a\n  select Jet[0].pt > 40\nregion b\n  select Jet[0].pt <= 40\nregion c\n  select Jet[0].eta == 0\nregion d\n  select Jet[0].eta ~= 0\n", [("a", "jet[1].pt > 40", "false"), ("b", "jet[1].pt <= 40", "false"), ("c", "jet[1].eta = 0", "false"), ("d", "jet[1].eta <> 0", "false")]),
    "bands": ("region a\n  select Jet[0].pt [] 20 60\nregion b\n  select Jet[0].pt ][ 20 60\n", [("a", "jet[1].pt between 20 and 60", "false"), ("b", "jet[1].pt <= 20 or jet[1].pt >= 60", "false")]),
    "chain": ("region a\n  select 20 < Jet[1].pt < 60\n", [("a", "jet[2].pt > 20 and jet[2].pt < 60", "false")]),
    "and_or_not": ("region a\n  select size(Jet) >= 2 and (Jet[0].btag == 1 or not Jet[1].btag == 1)\n", [("a", "len(jet) >= 2 and (jet[1].btag = 1 or not jet[2].btag = 1)", "false")]),
    "short_circuit": ("region a\n  select size(Jet) >= 3 and MET > 100\nregion b\n  select size(Jet) >= 3 or MET > 100\n", [("a", "len(jet) >= 3 and met > 100", "len(jet) >= 3 and met is null"), ("b", "len(jet) >= 3 or met > 100", "len(jet) < 3 and met is null")]),
    "ternary": ("region a\n  select size(Jet) > 3 ? Jet[0].pt > 60 : Jet[0].pt > 20\nregion b\n  select size(Jet) > 3 ? Jet[0].pt > 60\n", [("a", "case when len(jet) > 3 then jet[1].pt > 60 else jet[1].pt > 20 end", "false"), ("b", "case when len(jet) > 3 then jet[1].pt > 60 else true end", "false")]),
    "constants": ("region a\n  select ALL\nregion b\n  select NONE\n", [("a", "true", "false"), ("b", "false", "false")]),
    "number_as_predicate": ("region a\n  select Jet[0].eta\n", [("a", "jet[1].eta <> 0", "false")]),
    "predicate_as_number": ("region a\n  select (Jet[0].btag == 1) + (Jet[1].btag == 1) >= 1\n", [("a", "coalesce(jet[1].btag = 1, false)::int + coalesce(jet[2].btag = 1, false)::int >= 1", "false")]),
    "define_shadows_scalar": ("define HT = sum(Jet.pt)\nregion a\n  select HT > 150\n", [("a", "coalesce(list_sum(list_transform(jet, lambda x: x.pt)), 0) > 150", "false")]),
    "object_define": ("object g\n  take Jet\n  define lead = pt - 10\n  select lead > 30\nregion a\n  select size(g) >= 1\n", [("a", "len(list_filter(jet, lambda x: x.pt - 10 > 30)) >= 1", "false")]),
    "event_data": ("region a\n  select MET > 150\nregion b\n  select HT > 300\nregion c\n  select MET.phi > 1\n", [("a", "met > 150", HARD_MET), ("b", "ht > 300", HARD_HT), ("c", "metphi > 1", HARD_MET)]),
    "property_forms": ("region a\n  select pT(Jet[0]) > 50 and Jet[0].eta > 0 and {Jet[0]}phi > 0 and Jet_1.pt > 20\n", [("a", "jet[1].pt > 50 and jet[1].eta > 0 and jet[1].phi > 0 and jet[2].pt > 20", "false")]),
    "back_index": ("region a\n  select Jet[-1].pt > 20\nregion b\n  select Jet[-2].pt > 40\n", [("a", "jet[-1].pt > 20", "false"), ("b", "jet[-2].pt > 40", "false")]),
    "missing_property": ("region a\n  select Jet[0].m > 3\nregion b\n  reject Jet[0].m > 3\n", [("a", "coalesce(jet[1].m > 3, false)", "false"), ("b", "not coalesce(jet[1].m > 3, false)", "false")]),
    "presence": ("region a\n  select defined(Jet[0].m) == 1\nregion b\n  select defined(MET) == 0\n", [("a", "jet[1].m is not null", "false"), ("b", "met is null", "false")]),
    "out_of_fragment": ("region a\n  select Jet > 3\nregion b\n  select size(Jet) > 2 and fmt2(Jet[0]) > 3\n", [("a", "false", "true"), ("b", "false", "len(jet) > 2")]),
    "cartesian": ("object pairs\n  take Electron e, Muon\n", []),
    "size_count": (GOOD + "region a\n  select count(good) == 2\nregion b\n  select good.size == 3\n", [("a", f"len({G}) = 2", "false"), ("b", f"len({G}) = 3", "false")]),
    "any_all": ("region a\n  select any(pt(Jet) > 80)\nregion b\n  select all(pt(Jet) > 20)\nregion c\n  select any(m(Jet)) > 5\n", [("a", "len(list_filter(jet, lambda x: x.pt > 80)) > 0", "false"), ("b", "len(list_filter(jet, lambda x: not x.pt > 20)) = 0", "false"), ("c", "len(list_filter(jet, lambda x: coalesce(x.m > 5, false))) > 0", "false")]),
    "sum_reducer": ("region a\n  select sum(pt(Jet)) > 150\nregion b\n  select sum(m(Jet)) < 20\n", [("a", "coalesce(list_sum(list_transform(jet, lambda x: x.pt)), 0) > 150", "false"), ("b", "len(list_filter(jet, lambda x: x.m is null)) = 0 and coalesce(list_sum(list_transform(jet, lambda x: x.m)), 0) < 20", "false")]),
    "min_max_reducers": ("region a\n  select min(pt(Jet)) > 20\nregion b\n  select max(m(Jet)) > 5\nregion c\n  select min(pt(Jet)) * 2 < 30\n", [("a", "len(jet) > 0 and list_min(list_transform(jet, lambda x: x.pt)) > 20", "false"), ("b", "coalesce(list_max(list_transform(jet, lambda x: x.m)) > 5, false)", "false"), ("c", "len(jet) > 0 and list_min(list_transform(jet, lambda x: x.pt)) * 2 < 30", "false")]),
    "scalar_min_max": ("region a\n  select min(Jet[0].eta, Jet[1].eta) > -1\nregion b\n  select max(Jet[0].m, Jet[1].m) > 4\n", [("a", "jet[1].eta is not null and jet[2].eta is not null and least(jet[1].eta, jet[2].eta) > -1", "false"), ("b", "jet[1].m is not null and jet[2].m is not null and greatest(jet[1].m, jet[2].m) > 4", "false")]),
    "overlap_removal": ("object far\n  take Jet\n  reject any(dR(this, Electron) < 1)\nregion a\n  select size(far) >= 2\n", [("a", f"len(list_filter(jet, lambda x: len(list_filter(ele, lambda y: {dr('x', 'y')} < 1)) = 0)) >= 2", "false")]),
    "semi_join": ("object near\n  take Jet\n  select any(dR(this, Muon) < 1)\nregion a\n  select size(near) >= 1\n", [("a", f"len(list_filter(jet, lambda x: len(list_filter(muo, lambda y: {dr('x', 'y')} < 1)) > 0)) >= 1", "false")]),
    "whole_angles": ("region a\n  select dR(Electron, Muon) > 1\nregion b\n  select dR(Electron, Muon) < 1\n", [("a", f"len(list_filter(ele, lambda x: len(list_filter(muo, lambda y: not {dr('x', 'y')} > 1)) > 0)) = 0", "false"), ("b", f"len(list_filter(ele, lambda x: len(list_filter(muo, lambda y: {dr('x', 'y')} < 1)) > 0)) > 0", "false")]),
    "least_pair": ("region a\n  select dR(Electron, Muon) * 2 < 1\n", [("a", f"coalesce(list_min(flatten(list_transform(ele, lambda x: list_transform(muo, lambda y: {dr('x', 'y')})))) * 2 < 1, false)", "false")]),
    "sort_ascending": ("object s\n  take sort(Jet, eta, ascend)\nregion a\n  select s[0].eta < -1\n", [("a", "list_min(list_transform(jet, lambda x: x.eta)) < -1", "false")]),
    "sort_missing_first": ("object s\n  take sort(Jet, m, descend)\nregion a\n  select defined(s[0].m) == 0 and size(Jet) > 0\n", [("a", "len(list_filter(jet, lambda x: x.m is null)) > 0", "false")]),
    "region_sort": ("region a\n  sort eta(Jet) ascend\n  select Jet[0].eta < -1\n", [("a", "list_min(list_transform(jet, lambda x: x.eta)) < -1", "false")]),
    "slices": ("region a\n  select sum(pt(Jet[0:2])) > 100\nregion b\n  select size(Jet[1:]) >= 2\nregion c\n  select min(pt(Jet[:3])) > 20\n", [("a", "coalesce(list_sum(list_transform(jet[1:2], lambda x: x.pt)), 0) > 100", "false"), ("b", "len(jet[2:]) >= 2", "false"), ("c", "len(jet) > 0 and list_min(list_transform(jet[1:3], lambda x: x.pt)) > 20", "false")]),
    "unknown_sort": ("region a\n  sort nosuchthing(Jet) ascend\n  select size(Jet) >= 2\n  select Jet[0].pt > 20\nregion b\n  select Jet[0].pt > 20\n  sort nosuchthing(Jet) ascend\n", [("a", "false", "len(jet) >= 2"), ("b", "jet[1].pt > 20", "false")]),
    "unresolved_source": ("object g\n  take nosuch(Jet)\nregion a\n  select size(g) == 0\nregion b\n  select size(g) > 0 or size(Jet) > 2\n", [("a", "true", "false"), ("b", "len(jet) > 2", "false")]),
    "union": ("object lep : union(Electron, Muon)\nregion a\n  select size(lep) >= 2\nregion b\n  select lep[0].q == 1\n", [("a", "len(ele) + len(muo) >= 2", "false"), ("b", "case when len(ele) > 0 then true else false end", "false")]),
    "filters_compose": (GOOD + "object tagged\n  take good\n  select btag == 1\nobject same\n  take tagged\nregion a\n  select size(same) >= 1\n", [("a", f"len(list_filter({G}, lambda x: x.btag = 1)) >= 1", "false")]),
    "absent_collection": ("region a\n  select size(Photon) == 0\nregion b\n  select Photon[0].pt > 0\n", [("a", "true", "false"), ("b", "false", "false")]),
    "binders_alias": ("object g\n  take Jet j alias gg\n  select pt(j) > 30\nregion a\n  select size(gg) >= 2\n", [("a", "len(list_filter(jet, lambda x: x.pt > 30)) >= 2", "false")]),
    "arithmetic": ("region a\n  select (Jet[0].pt + Jet[1].pt) * 2 - 10 > 150\nregion b\n  select Jet[0].pt / Jet[0].eta > 30\nregion c\n  select Jet[0].eta ^ 2 > 4\nregion d\n  select Jet[0].eta + 0.5 == 1\n", [("a", "(jet[1].pt + jet[2].pt) * 2 - 10 > 150", "false"), ("b", "case when jet[1].eta = 0 then false else jet[1].pt / jet[1].eta > 30 end", "false"), ("c", "jet[1].eta ^ 2 > 4", "false"), ("d", "jet[1].eta + 0.5 = 1", "false")]),
    "exact_products": (
        "region a\n  select Jet[0].pt * 3 - Jet[0].pt - Jet[0].pt == Jet[0].pt\nregion b\n  select Jet[0].pt / 3 * 3 == Jet[0].pt\nregion c\n  select Jet[0].pt * Jet[0].eta == Jet[0].pt * 0.5 + Jet[0].pt * 0.5\nregion d\n  select 1 / Jet[0].eta >= 2\n",
        [("a", "len(jet) > 0", "false"), ("b", "len(jet) > 0", "false"), ("c", "jet[1].eta = 1", "false"), ("d", "jet[1].eta = 0.5", "false")],
    ),
    "abs_forms": ("region a\n  select |Jet[0].eta| < 1\nregion b\n  select abs(Jet[0].eta) > 2 and -Jet[0].eta > 0\n", [("a", "abs(jet[1].eta) < 1", "false"), ("b", "abs(jet[1].eta) > 2 and -jet[1].eta > 0", "false")]),
    "functions": ("region a\n  select sqrt(Jet[0].pt) > 7\nregion b\n  select cos(Jet[0].phi) > 0.5\nregion c\n  select log(Jet[0].eta) > 0\nregion d\n  select sqrt(2 * Jet[0].pt * Jet[1].pt * (1 - cos(Jet[0].phi - Jet[1].phi))) > 60\n", [("a", "sqrt(jet[1].pt) > 7", "false"), ("b", "cos(jet[1].phi) > 0.5", "false"), ("c", "case when jet[1].eta > 0 then ln(jet[1].eta) > 0 else false end", "false"), ("d", "sqrt(2 * jet[1].pt * jet[2].pt * (1 - cos(jet[1].phi - jet[2].phi))) > 60", "false")]),
    "four_vectors": ("region a\n  select m(Jet[0] + Jet[1]) > 60\nregion b\n  select pT(Jet[0] Jet[1]) > 50\n", [("a", f"coalesce({vec(['jet[1]', 'jet[2]'], 'm')} > 60, false)", "false"), ("b", f"coalesce({vec(['jet[1]', 'jet[2]'], 'pt')} > 50 and jet[1].m is not null and jet[2].m is not null, false)", "false")]),
    "delta_phi": ("region a\n  select dPhi(Jet[0], Jet[1]) > 1\nregion b\n  select dPhi(Jet[0], MET) < -1\n", [("a", f"{dphi('jet[1].phi', 'jet[2].phi')} > 1", "false"), ("b", f"{dphi('jet[1].phi', 'metphi')} < -1", HARD_MET)]),
    "delta_eta_r": ("region a\n  select dEta(Jet[0], Jet[1]) > 1\nregion b\n  select dR(Jet[0], Jet[1]) < 1.5\nregion c\n  select dR(Jet[0], MET) < 9\n", [("a", "jet[1].eta - jet[2].eta > 1", "false"), ("b", f"{dr('jet[1]', 'jet[2]')} < 1.5", "false"), ("c", "false", HARD_MET)]),
    "external_function": ("region a\n  select fht(Jet) > 150\n", [("a", "coalesce(list_sum(list_transform(jet, lambda x: x.pt)), 0) > 150", "false")]),
    "lookup_table": ("table eff\n  tabletype efficiency\n  nvars 1\n  errors false\n  0.2 0 30\n  0.6 30 60\n  0.9 60 1000\nregion a\n  select eff(Jet[0].pt) > 0.5\n", [("a", "jet[1].pt >= 30", "false")]),
    "combination": ("object pairs\n  take disjoint(Jet a, Jet b)\n  select a.pt + b.pt > 100\nregion a\n  select size(pairs) >= 2\n", [("a", "len(flatten(list_transform(jet, lambda x, i: list_filter(jet, lambda y, j: j > i and not (x.pt = y.pt and x.eta = y.eta and x.phi = y.phi and x.m is not distinct from y.m) and x.pt + y.pt > 100)))) >= 2", "false")]),
    "cross_combination": ("object pairs\n  take cartesian(Electron e, Muon u)\n  candidate z = e + u\n  select m(z) > 40\nregion a\n  select size(pairs) >= 1\nregion b\n  select max(pt(pairs->e)) > 50\n", [("a", f"len(flatten(list_transform(ele, lambda x: list_filter(muo, lambda y: coalesce({vec(['x', 'y'], 'm')} > 40, false))))) >= 1", "false"), ("b", f"len(list_filter(ele, lambda x: x.pt > 50 and len(list_filter(muo, lambda y: coalesce({vec(['x', 'y'], 'm')} > 40, false))) > 0)) > 0", "false")]),
    "notes_ignored": ('region a\n  print Jet[0].pt\n  save out csv Jet[0].pt\n  select size(Jet) > 1\ninfo analysis\n  title "t"\n', [("a", "len(jet) > 1", "false")]),
}
del REGIONS["cartesian"]

EX = GOOD + """object tagged
  take good
  select btag == 1
region base
  select ALL
  select size(good) >= 2
  weight w 0.5
  select pT(good[0]) > 60
  trigger urgent
region tight
  base
  select size(tagged) >= 1
  select MET > 200
  bin MET 200 250 300 400
  bin size(good) >= 4
  histo hmet, "MET", 20, 100, 500, MET
  histo hvar, "lead", 30 50 70 90, pT(good[0])
  histo hxy, "both", 4, 0, 120, 5, 0, 500, pT(good[0]), MET
"""
_T = f"tags as (select *, {G} as good, list_filter({G}, lambda x: x.btag = 1) as tagged from ev)"
_CUTS = {"base": ["true", "len(good) >= 2", "good[1].pt > 60", "urgent = 1"], "tight": ["len(good) >= 2 and good[1].pt > 60 and urgent = 1", "len(tagged) >= 1", "met > 200"]}
_PASS = "(len(good) >= 2 and good[1].pt > 60 and urgent = 1 and len(tagged) >= 1 and met > 200)"
_LABELS = {"base": ["select ALL", "select size(good) >= 2", "select pT(good[0]) > 60", "trigger urgent"], "tight": ["base", "select size(tagged) >= 1", "select MET > 200"]}
_KINDS = {"base": ["select", "select", "select", "trigger"], "tight": ["inherit", "select", "select"]}


def _cutflow_sql() -> str:
    out = []
    for r, cuts in _CUTS.items():
        for k in range(len(cuts) + 1):
            upto = " and ".join(f"coalesce({c}, false)" for c in cuts[:k]) or "true"
            f = 0.5 if r == "base" and k > 2 else 1.0
            label, kind = ("all events", "all") if not k else (_LABELS[r][k - 1], _KINDS[r][k - 1])
            fails = f"count(*) filter (where ({' and '.join(f'coalesce({c}, false)' for c in cuts[: k - 1]) or 'true'}) and met is null)" if r == "tight" and k == 3 else "0"
            out.append(f"select '{r}' as region, {k} as step, '{kind}' as kind, '{label}' as label, count(*) filter (where {upto}) as raw, coalesce(sum(w) filter (where {upto}), 0) * {f} as sumw, coalesce(sum(w * w) filter (where {upto}), 0) * {f * f} as sumw2, {fails} as errors, false as weighted_incomplete from tags")
    return EVENTS_SQL + f", {_T}\n" + "\nunion all\n".join(out)


BINS_SQL = EVENTS_SQL + f""", {_T}, p as (select * from tags where {_PASS}),
b as (select 0 as statement, 'bin MET 200 250 300 400' as label, case when met >= 400 then '3' when met >= 300 then '2' when met >= 250 then '1' when met >= 200 then '0' else 'out' end as slot, w from p
      union all select 1, 'bin size(good) >= 4', case when len(good) >= 4 then 'yes' else 'no' end, w from p)
select 'tight' as region, statement, label, slot, count(*) as raw, sum(w) as sumw, sum(w * w) as sumw2 from b group by all"""

_HISTO_SQL = EVENTS_SQL + f""", {_T}, p as (select *, good[1].pt as lead from tags where {_PASS}),
u as (select 'hmet' as histogram, 'h1' as kind, case when met < 100 then 0 when met >= 500 then 21 else least(floor((met - 100) / 400 * 20), 19) + 1 end as cell, case when met < 500 then met end as x, null::double as y, w from p
      union all select 'hvar', 'h1var', case when lead >= 90 then 4 when lead >= 70 then 3 when lead >= 50 then 2 when lead >= 30 then 1 else 0 end, case when lead < 90 then lead end, null, w from p
      union all select 'hxy', 'h2', (case when lead >= 120 then 5 else least(floor(lead / 120 * 4), 3) + 1 end) + 6 * (case when met >= 500 then 6 else least(floor(met / 500 * 5), 4) + 1 end), case when lead < 120 and met < 500 then lead end, case when lead < 120 and met < 500 then met end, w from p)
select 'tight' as region, histogram, kind, cell::bigint as cell, count(*) as entries, sum(w) as sumw, sum(w * w) as sumw2,
       round(coalesce(sum(w * x), 0), 6) as sumwx, round(coalesce(sum(w * x * x), 0), 6) as sumwx2, round(coalesce(sum(w * y), 0), 6) as sumwy, round(coalesce(sum(w * y * y), 0), 6) as sumwy2, round(coalesce(sum(w * x * y), 0), 6) as sumwxy
from u group by all"""


def _regions(source: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, d: str) -> DataFrame:
        return counts(plan(analyse(source), events_from_tables(spark, d)))

    return query


def _regions_sql(rows: list[tuple[str, str, str]]) -> str:
    one = "select '{0}' as region, sum(case when {2} then 0 when {1} then 1 else 0 end)::bigint as passed, sum(case when {2} then 0 when {1} then w else 0 end)::double as sumw, sum(case when {2} then 1 else 0 end)::bigint as errors from ev"
    return EVENTS_SQL + "\nunion all\n".join(one.format(*r) for r in rows)


def _fht(jets):
    return F.aggregate(F.transform(jets, lambda j: j["pt"]), F.lit(0.0), lambda a, v: a + v)


def external_query(spark: SparkSession, d: str) -> DataFrame:
    """fht is registered for this query alone."""
    before = REGISTRY.get("fht")
    register("fht", _fht, lambda jets: float(sum(j["pt"] for j in jets)))
    try:
        return _regions(REGIONS["external_function"][0])(spark, d)
    finally:
        unregister("fht")
        if before is not None:
            REGISTRY["fht"] = before


def jsonl_query(spark: SparkSession, d: str) -> DataFrame:
    """Events as JSON lines, some of them damaged: how many are refused, by what is wrong."""
    line, k = F.to_json(F.struct(F.col("jet").alias("Jet"), F.col("weight").alias("weight"))), F.col("event") % 7
    damaged = F.when(k == 0, F.substring(line, 1, 9)).when(k == 1, F.lit('{"Jet":"oops"}')).when(k == 2, F.lit('{"jet":[{"pt":"x"}]}')).when(k == 3, F.lit("not json")).when(k == 4, F.lit('{"weight":"heavy"}')).otherwise(line)
    e = parse_events(events_from_tables(spark, d).select("event", damaged.alias("value")), analyse("region r\n  select size(Jet) >= 0\n"), key="event", refuse=False)
    wrong = F.when(F.col("_parse_error").contains("JSON object"), "line").when(F.col("_parse_error").startswith("jet"), "jet").when(F.col("_parse_error").startswith("weight"), "weight")
    return e.groupBy(F.coalesce(wrong, F.lit("none")).alias("wrong")).agg(F.count("*").alias("n"), F.sum(F.size("jet").cast("long")).alias("n_jets"))


def _leaves(spark: SparkSession, d: str, sep: str, spell: dict[str, str]) -> DataFrame:
    """The events as flat leaf columns of a detector layout."""
    e = events_from_tables(spark, d).withColumn("jet", F.coalesce("jet", F.array().cast("array<struct<pt:double,eta:double,phi:double,m:double,btag:double,q:double>>")))
    leaf = lambda c, p: F.transform(c, lambda x: x[p])
    return e.select("event", *[leaf(c, p).alias(f"{o}{sep}{spell[p]}") for c, o in (("jet", "Jet"), ("muon", "Muon"), ("electron", "Tau"), ("electron", "Electron")) for p in ("pt", "eta", "phi", "m", "q") if (c, p) != ("jet", "q")], *[F.transform("jet", lambda x: (x["btag"] + 2).cast("int")).alias(f"{o}{sep}{spell['btag']}") for o in ("Jet", "FatJet")], leaf("jet", "pt").alias(f"FatJet{sep}{spell['pt']}"), F.transform("muon", lambda x: x["q"] < 0).alias(f"Muon{sep}tightId"), "met", "weight")


def delphes_query(spark: SparkSession, d: str) -> DataFrame:
    """Sums over a columnar table read through the Delphes layout: tags are a bit, lepton masses are constants."""
    df = _leaves(spark, d, ".", {"pt": "PT", "eta": "Eta", "phi": "Phi", "m": "Mass", "q": "Charge", "btag": "BTag"})
    df = df.select("*", F.array("met.pt").alias("MissingET.MET"), F.array("met.phi").alias("MissingET.Phi"), F.array("weight").alias("Event.Weight")).drop("met", "weight")
    e = ingest(df, "delphes", "event")
    return _summed(e, {"jet": ("pt", "m", "btag"), "fatjet": ("pt", "btag"), "electron": ("m",), "muon": ("m", "q")})


def nanoaod_query(spark: SparkSession, d: str) -> DataFrame:
    """The same through the NanoAOD layout: discriminants as they stand, masses from their leaves."""
    df = _leaves(spark, d, "_", {"pt": "pt", "eta": "eta", "phi": "phi", "m": "mass", "q": "charge", "btag": "btagDeepB"})
    df = df.select("*", F.col("met.pt").alias("MET_pt"), F.col("met.phi").alias("MET_phi"), F.col("weight").alias("genWeight")).drop("met", "weight")
    return _summed(ingest(df, "nanoaod", "event"), {"jet": ("pt", "m", "btagdeepb"), "fatjet": ("pt", "btagdeepb"), "tau": ("pt", "q"), "muon": ("m", "tightid")})


def _summed(e: DataFrame, sums: dict[str, tuple[str, ...]]) -> DataFrame:
    total = lambda c, p: F.round(F.sum(F.aggregate(F.transform(c, lambda x: F.coalesce(x[p], F.lit(0.0))), F.lit(0.0), lambda a, v: a + v)), 3)
    each = [x for c, ps in sums.items() for x in (F.sum(F.size(c).cast("long")).alias(f"n_{c}"), *[total(c, p).alias(f"{c}_{p}") for p in ps])]
    return e.agg(F.count("*").alias("n"), F.count("met").alias("n_met"), F.round(F.sum("met.pt"), 3).alias("met_pt"), F.sum("weight").alias("weight"), *each)


def example(spark: SparkSession, d: str):
    return plan(analyse(EX), events_from_tables(spark, d))


def cutflow_query(spark: SparkSession, d: str) -> DataFrame:
    return cutflow(example(spark, d))


def bins_query(spark: SparkSession, d: str) -> DataFrame:
    return bin_flow(example(spark, d))


def histogram_query(spark: SparkSession, d: str) -> DataFrame:
    h = histograms(example(spark, d))
    return h.select("region", "histogram", "kind", "cell", "entries", "sumw", "sumw2", *[F.round(m, 6).alias(m) for m in ("sumwx", "sumwx2", "sumwy", "sumwy2", "sumwxy")])


def membership_query(spark: SparkSession, d: str) -> DataFrame:
    return membership(example(spark, d)).select("event", "region", "pass", F.col("error").isNotNull().alias("failed"))


DECISIVE = """region a
  select MET > 100
  select size(Jet) >= 3
region b
  select MET > 100 or size(Jet) >= 3
region c
  select HT > 300 and MET > 100
region d
  b
  select Jet[0].pt * MET > 5000
region e
  select MET > 100 ? size(Jet) >= 2 : size(Jet) >= 2
  select sum(pt(Jet)) + HT > 250
"""
_NO_C = "(coalesce(ht <= 300, false) or coalesce(met <= 100, false))"
_NO_D = "(len(jet) = 0 or coalesce(met <= 100 and len(jet) < 3, false) or coalesce(jet[1].pt * met <= 5000, false))"
_NO_E = "(len(jet) < 2 or coalesce(coalesce(list_sum(list_transform(jet, lambda x: x.pt)), 0) + ht <= 250, false))"
_DECIDED = [
    ("a", "met > 100 and len(jet) >= 3", "met is null and len(jet) >= 3"),
    ("b", "coalesce(met > 100, false) or len(jet) >= 3", "met is null and len(jet) < 3"),
    ("c", "ht > 300 and met > 100", f"(met is null or ht is null) and not {_NO_C}"),
    ("d", f"not {_NO_D}", f"met is null and not {_NO_D}"),
    ("e", f"not {_NO_E}", f"ht is null and not {_NO_E}"),
]


def decisive_query(spark: SparkSession, d: str) -> DataFrame:
    """Three-valued membership: a cut that decides counts wherever it stands among cuts that fail."""
    return counts(plan(analyse(DECISIVE), events_from_tables(spark, d), decisive=True))


HISTO_LIST = """object good
  take Jet
  select pT(Jet) > 30
histoList spectra
  histo hn, "jets", 4, 0, 4, size(good)
  histo hpt, "lead", 20 40 60 90, pT(Jet[0])
region low
  select size(good) < 3
  spectra
region high
  select size(good) >= 3
  spectra
"""


def histo_list_query(spark: SparkSession, d: str) -> DataFrame:
    """One list of histograms, made anew in each region that names it."""
    return histograms(plan(analyse(HISTO_LIST), events_from_tables(spark, d))).select("region", "histogram", "kind", "cell", "entries", "sumw", "sumw2")


def validation_query(spark: SparkSession, d: str) -> DataFrame:
    e = events_from_tables(spark, d)
    bad = e.withColumn("jet", F.when(F.col("event") % 7 == 0, F.reverse("jet")).otherwise(F.col("jet")))
    return validated(bad).groupBy(F.col("_load_error").isNotNull().alias("refused")).agg(F.count("*").alias("n"))


def crosstab_query(spark: SparkSession, d: str) -> DataFrame:
    from .prover.verdicts import crosstab

    src = GOOD + "region low\n  select size(good) < 2\nregion high\n  select size(good) >= 2\nregion top\n  select size(good) >= 4\n"
    return crosstab(plan(analyse(src), events_from_tables(spark, d)))


_MEMBER_SQL = EVENTS_SQL + f""", {_T}
select event, 'base' as region, coalesce(len(good) >= 2 and good[1].pt > 60 and urgent = 1, false) as pass, false as failed from tags
union all select event, 'tight', case when len(good) >= 2 and good[1].pt > 60 and urgent = 1 and len(tagged) >= 1 and met is null then null else coalesce({_PASS}, false) end,
       coalesce(len(good) >= 2 and good[1].pt > 60 and urgent = 1 and len(tagged) >= 1 and met is null, false) from tags"""
_VALID_SQL = EVENTS_SQL + "select coalesce(event % 7 = 0 and len(list_distinct(list_transform(jet, lambda x: x.pt))) > 1, false) as refused, count(*) as n from ev group by 1"
_CROSS_SQL = EVENTS_SQL + f""", r as (select len({G}) < 2 as low, len({G}) >= 2 as high, len({G}) >= 4 as top from ev)
""" + "\nunion all\n".join(f"select '{a}' as \"left\", '{b}' as \"right\", count(*) filter (where {a} and {b}) as \"both\", count(*) filter (where {a} and not {b}) as left_only, count(*) filter (where {b} and not {a}) as right_only from r" for a, b in (("low", "high"), ("low", "top"), ("high", "top")))

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _regions(src) for name, (src, _) in REGIONS.items()}
ORACLES: dict[str, str] = {name: _regions_sql(rows) for name, (_, rows) in REGIONS.items()}

_JSONL_SQL = EVENTS_SQL + """select case event % 7 when 0 then 'line' when 1 then 'jet' when 2 then 'jet' when 3 then 'line' when 4 then 'weight' else 'none' end as wrong,
       count(*) as n, sum(case when event % 7 > 4 then len(jet) else 0 end)::bigint as n_jets from ev group by 1"""
_SUM = "round(coalesce(sum(list_sum(list_transform({0}, lambda x: coalesce({1}, 0)::double))), 0), 3)"
_HEAD = EVENTS_SQL + "select count(*) as n, count(met) as n_met, round(sum(met), 3) as met_pt, sum(w) as weight, "


def _sums_sql(*parts: tuple[str, str, str]) -> str:
    return _HEAD + ", ".join(f"sum(len({c}))::bigint as {name}" if not x else f"{_SUM.format(c, x)} as {name}" for name, c, x in parts) + " from ev"


_DELPHES_SQL = _sums_sql(("n_jet", "jet", ""), ("jet_pt", "jet", "x.pt"), ("jet_m", "jet", "x.m"), ("jet_btag", "jet", "x.btag"), ("n_fatjet", "jet", ""), ("fatjet_pt", "jet", "x.pt"), ("fatjet_btag", "jet", "x.btag"), ("n_electron", "ele", ""), ("electron_m", "ele", "0.000511"), ("n_muon", "muo", ""), ("muon_m", "muo", "0.105658"), ("muon_q", "muo", "x.q"))
_NANOAOD_SQL = _sums_sql(("n_jet", "jet", ""), ("jet_pt", "jet", "x.pt"), ("jet_m", "jet", "x.m"), ("jet_btagdeepb", "jet", "x.btag + 2"), ("n_fatjet", "jet", ""), ("fatjet_pt", "jet", "x.pt"), ("fatjet_btagdeepb", "jet", "x.btag + 2"), ("n_tau", "ele", ""), ("tau_pt", "ele", "x.pt"), ("tau_q", "ele", "x.q"), ("n_muon", "muo", ""), ("muon_m", "muo", "x.m"), ("muon_tightid", "muo", "1"))
QUERIES |= {"external_function": external_query, "jsonl_validation": jsonl_query, "delphes_profile": delphes_query, "nanoaod_profile": nanoaod_query}
_N = "len(list_filter(jet, lambda x: x.pt > 30))"
_LIST_SQL = EVENTS_SQL + f"""select case when n < 3 then 'low' else 'high' end as region, histogram, kind, cell::bigint as cell, count(*) as entries, sum(w) as sumw, sum(w * w) as sumw2
from (select {_N} as n, 'hn' as histogram, 'h1' as kind, least({_N}, 4) + 1 as cell, w from ev
      union all select {_N}, 'hpt', 'h1var', case when len(jet) = 0 then -1 when jet[1].pt >= 90 then 4 when jet[1].pt >= 60 then 3 when jet[1].pt >= 40 then 2 when jet[1].pt >= 20 then 1 else 0 end, w from ev) group by all"""
QUERIES |= {"decisive_membership": decisive_query, "histo_list": histo_list_query}
ORACLES |= {"decisive_membership": _regions_sql(_DECIDED), "histo_list": _LIST_SQL}
ORACLES |= {"jsonl_validation": _JSONL_SQL, "delphes_profile": _DELPHES_SQL, "nanoaod_profile": _NANOAOD_SQL}
QUERIES |= {"cutflow": cutflow_query, "bin_flow": bins_query, "histograms": histogram_query, "membership": membership_query, "load_validation": validation_query, "relation_crosstab": crosstab_query}
ORACLES |= {"cutflow": _cutflow_sql(), "bin_flow": BINS_SQL, "histograms": _HISTO_SQL, "membership": _MEMBER_SQL, "load_validation": _VALID_SQL, "relation_crosstab": _CROSS_SQL}
