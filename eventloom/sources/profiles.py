"""Columnar detector layouts as rename tables: flat leaf columns to canonical events.

Input is a DataFrame (say of Parquet files) with one array column a leaf; the leaves of a
collection are zipped into structs. Leaves of one collection that differ in length in an event raise. Leaves that no
profile names are reported by class, not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Leaf:
    prop: str
    column: str
    bit: int | None = None  # a tag kept as one bit of an integer


@dataclass(frozen=True)
class Profile:
    name: str
    collections: dict[str, tuple[Leaf, ...]]
    constants: dict[str, dict[str, float]] = field(default_factory=dict)
    met: tuple[str, str] = ("", "")
    scalars: dict[str, str] = field(default_factory=dict)
    weight: str = ""
    first: bool = False  # met and scalars are arrays of one element
    sep: str = "_"  # between a branch and its leaf
    dropped: tuple[str, ...] = ()  # branches known and left out
    counter: str = "n{}"  # a branch's counter


ELECTRON_MASS, MUON_MASS = 0.000511, 0.105658
DELPHES = Profile(
    "delphes",
    {
        "jet": (Leaf("pt", "Jet.PT"), Leaf("eta", "Jet.Eta"), Leaf("phi", "Jet.Phi"), Leaf("m", "Jet.Mass"), Leaf("btag", "Jet.BTag", 0), Leaf("tautag", "Jet.TauTag", 0)),
        "fatjet": (Leaf("pt", "FatJet.PT"), Leaf("eta", "FatJet.Eta"), Leaf("phi", "FatJet.Phi"), Leaf("m", "FatJet.Mass"), Leaf("btag", "FatJet.BTag", 0), Leaf("tautag", "FatJet.TauTag", 0)),
        "electron": (Leaf("pt", "Electron.PT"), Leaf("eta", "Electron.Eta"), Leaf("phi", "Electron.Phi"), Leaf("q", "Electron.Charge")),
        "muon": (Leaf("pt", "Muon.PT"), Leaf("eta", "Muon.Eta"), Leaf("phi", "Muon.Phi"), Leaf("q", "Muon.Charge")),
        "photon": (Leaf("pt", "Photon.PT"), Leaf("eta", "Photon.Eta"), Leaf("phi", "Photon.Phi"), Leaf("e", "Photon.E")),
    },
    {"electron": {"m": ELECTRON_MASS}, "muon": {"m": MUON_MASS}},
    ("MissingET.MET", "MissingET.Phi"),
    {"ht": "ScalarHT.HT"},
    "Event.Weight",
    True,
    ".",
    ("Event", "Weight", "Particle", "Track", "Tower", "EFlowTrack", "EFlowPhoton", "EFlowNeutralHadron", "GenJet", "GenMissingET"),
    "{}_size",
)
NANOAOD = Profile(
    "nanoaod",
    {
        "jet": (Leaf("pt", "Jet_pt"), Leaf("eta", "Jet_eta"), Leaf("phi", "Jet_phi"), Leaf("m", "Jet_mass"), Leaf("btagdeepb", "Jet_btagDeepB"), Leaf("btagdeepflavb", "Jet_btagDeepFlavB"), Leaf("btagcsvv2", "Jet_btagCSVV2"), Leaf("jetid", "Jet_jetId"), Leaf("puid", "Jet_puId")),
        "fatjet": (Leaf("pt", "FatJet_pt"), Leaf("eta", "FatJet_eta"), Leaf("phi", "FatJet_phi"), Leaf("m", "FatJet_mass"), Leaf("btagdeepb", "FatJet_btagDeepB"), Leaf("btagcsvv2", "FatJet_btagCSVV2")),
        "electron": (Leaf("pt", "Electron_pt"), Leaf("eta", "Electron_eta"), Leaf("phi", "Electron_phi"), Leaf("m", "Electron_mass"), Leaf("q", "Electron_charge")),
        "muon": (Leaf("pt", "Muon_pt"), Leaf("eta", "Muon_eta"), Leaf("phi", "Muon_phi"), Leaf("m", "Muon_mass"), Leaf("q", "Muon_charge"), Leaf("tightid", "Muon_tightId"), Leaf("looseid", "Muon_looseId"), Leaf("pfisoid", "Muon_pfIsoId")),
        "tau": (Leaf("pt", "Tau_pt"), Leaf("eta", "Tau_eta"), Leaf("phi", "Tau_phi"), Leaf("m", "Tau_mass"), Leaf("q", "Tau_charge")),
        "photon": (Leaf("pt", "Photon_pt"), Leaf("eta", "Photon_eta"), Leaf("phi", "Photon_phi"), Leaf("m", "Photon_mass")),
    },
    met=("MET_pt", "MET_phi"),
    weight="genWeight",
)
PROFILES = {p.name: p for p in (DELPHES, NANOAOD)}


def _zipped(leaves: list[Leaf], constants: dict[str, float]) -> Column:
    size = lambda x: F.coalesce(F.size(F.col(f"`{x.column}`")), F.lit(0))
    even = reduce(lambda a, b: a & b, [size(x) == size(leaves[0]) for x in leaves[1:]], F.lit(True))
    said = F.concat(F.lit("leaves differ in length: "), F.concat_ws(", ", *[F.concat(F.lit(f"{x.column} has "), size(x).cast("string")) for x in leaves]))
    z = F.arrays_zip(*[F.col(f"`{x.column}`").alias(f"f{i}") for i, x in enumerate(leaves)])
    if len(leaves) > 1:
        z = F.when(even, z).otherwise(F.raise_error(said))

    def element(s: Column) -> Column:
        got = [(F.getbit(s[f"f{i}"].cast("long"), F.lit(x.bit)) if x.bit is not None else s[f"f{i}"]).cast("double").alias(x.prop) for i, x in enumerate(leaves)]
        return F.struct(*got, *[F.lit(v).alias(k) for k, v in constants.items()])

    return F.transform(F.coalesce(z, F.array()), element)


def ingest(df: DataFrame, profile: str | Profile, key: str | None = None) -> DataFrame:
    """Canonical events of a columnar table; a collection whose leaves are all absent is left out."""
    p = PROFILES[profile] if isinstance(profile, str) else profile
    have = set(df.columns)
    q = lambda n: F.col(f"`{n}`")

    def one(n: str) -> Column:
        return F.get(q(n), F.lit(0)).cast("double") if p.first else q(n).cast("double")

    out = [(F.col(key) if key else F.monotonically_increasing_id()).alias("event")]
    for name, leaves in p.collections.items():
        there = [x for x in leaves if x.column in have]
        if there:
            out.append(_zipped(there, p.constants.get(name, {})).alias(name))
    if p.met[0] in have:
        pt = one(p.met[0])
        out.append(F.when(pt.isNotNull(), F.struct(pt.alias("pt"), (one(p.met[1]) if p.met[1] in have else F.lit(None).cast("double")).alias("phi"))).alias("met"))
    out += [one(c).alias(n) for n, c in p.scalars.items() if c in have]
    if p.weight in have:
        out.append(one(p.weight).alias("weight"))
    return df.select(*out)


def unmapped(df: DataFrame, profile: str | Profile) -> list[str]:
    """Columns that the profile doesn't read."""
    p = PROFILES[profile] if isinstance(profile, str) else profile
    known = {x.column for ls in p.collections.values() for x in ls} | set(p.met) | set(p.scalars.values()) | {p.weight}
    return sorted(set(df.columns) - known)


def unmapped_classes(df: DataFrame, profile: str | Profile) -> dict[str, dict[str, list[str]]]:
    """Columns that the profile doesn't read, by branch: ``unmapped`` leaves of branches that it reads, ``dropped`` branches that it
    knows and leaves out, and ``unknown`` ones (a column without a leaf is a branch of its own). Counters go with their branch."""
    p = PROFILES[profile] if isinstance(profile, str) else profile
    branch = lambda c: c.partition(p.sep)[0]
    mapped = {branch(x.column) for ls in p.collections.values() for x in ls} | {branch(c) for c in (*p.met, *p.scalars.values()) if p.sep in c}
    head, _, tail = p.counter.partition("{}")
    out: dict[str, dict[str, list[str]]] = {"unmapped": {}, "dropped": {}, "unknown": {}}
    for c in unmapped(df, p):
        of = c.removeprefix(head).removesuffix(tail) if c.startswith(head) and c.endswith(tail) and len(c) > len(head + tail) else None
        if of in mapped or of in p.dropped:
            continue
        b = branch(c)
        kind = "unmapped" if b in mapped and p.sep in c else "dropped" if b in p.dropped else "unknown"
        out[kind].setdefault(of if of and kind == "unknown" and p.sep not in c else b, []).append(c)
    return out


def ignored_tag_bits(df: DataFrame, profile: str | Profile) -> DataFrame:
    """``column, bit, values``: how many values of each tag leaf have bits set other than the one that is read. One pass, of which
    a row a tag leaf comes back."""
    p = PROFILES[profile] if isinstance(profile, str) else profile
    tags = [x for ls in p.collections.values() for x in ls if x.bit is not None and x.column in df.columns]
    if not tags:
        return df.sparkSession.createDataFrame([], "column string, bit int, values long")
    other = lambda x: F.size(F.filter(F.col(f"`{x.column}`"), lambda v: v.cast("long").bitwiseAND(F.lit(~(1 << x.bit)).cast("long")) != 0))
    rows = F.array(*[F.struct(F.lit(x.column).alias("column"), F.lit(x.bit).alias("bit"), F.coalesce(other(x), F.lit(0)).cast("long").alias("n")) for x in tags])
    return df.select(F.inline(rows)).groupBy("column", "bit").agg(F.sum("n").alias("values"))
