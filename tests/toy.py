"""Toy events with every kind of gap, as rows for Spark and dicts for the evaluator."""

import random

SCHEMA = "event long, jet array<struct<pt:double,eta:double,phi:double,m:double,btag:double,q:double>>, electron array<struct<pt:double,eta:double,phi:double,m:double,btag:double,q:double>>, muon array<struct<pt:double,eta:double,phi:double,m:double,btag:double,q:double>>, met struct<pt:double,phi:double>, ht double, triggers struct<urgent:double>, weight double"
PROPS = ("pt", "eta", "phi", "m", "btag", "q")


def events(n: int, seed: int = 1) -> list[dict]:
    r = random.Random(seed)

    def objects(most: int) -> list[dict]:
        got = [{"pt": round(r.uniform(1, 110), 1), "eta": round(r.uniform(-2.5, 2.5), 1), "phi": round(r.uniform(-3.1, 3.1), 1), "m": round(r.uniform(0, 9), 1) if r.random() < 0.7 else None, "btag": float(r.random() < 0.4), "q": r.choice([-1.0, 0.0, 1.0])} for _ in range(r.randint(0, most))]
        return sorted(got, key=lambda o: -o["pt"])

    return [{"event": i, "jet": objects(6), "electron": objects(2), "muon": objects(2), "met": {"pt": round(r.uniform(0, 500), 1), "phi": round(r.uniform(-3.1, 3.1), 1)} if r.random() < 0.8 else None, "ht": round(r.uniform(0, 900), 1) if r.random() < 0.8 else None, "triggers": {"urgent": float(r.random() < 0.5)}, "weight": r.choice([0.5, 1.0, 2.0])} for i in range(n)]


def rows(evs: list[dict]) -> list[tuple]:
    obj = lambda o: tuple(o[p] for p in PROPS)
    return [(e["event"], [obj(o) for o in e["jet"]], [obj(o) for o in e["electron"]], [obj(o) for o in e["muon"]], (e["met"]["pt"], e["met"]["phi"]) if e["met"] else None, e["ht"], (e["triggers"]["urgent"],), e["weight"]) for e in evs]
