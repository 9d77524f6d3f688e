"""Sinks: canonical JSON lines, per-event results, and files of aggregated results."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .lines import blank, numbered_lines

#: Lines that are hashed together at first.
FINE = 4096


def write_jsonl(events: DataFrame, path: str) -> None:
    """Canonical events, one JSON object a line, by all tasks."""
    cols = [c for c in events.columns if c != "event" and not c.startswith("_")]
    events.select(F.to_json(F.struct(*cols)).alias("value")).write.text(path)


def write_results(results: DataFrame, path: str) -> None:
    """One JSON object an event: its regions, in order, with pass, error and bins. Nothing is shuffled."""
    named = F.transform("regions", lambda r: F.struct(r["region"].alias("name"), r["pass"].alias("pass"), r["error"].alias("error"), r["bins"].alias("bins")))
    results.select(F.to_json(F.struct("event", named.alias("regions"))).alias("value")).write.text(path)


def write_ordered_results(results: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """``write_results`` with the rows in the order of ``event``: part files hold consecutive ranges, so read one after
    another in the order of their names they are in input order. The ranges are chosen from the events' count."""
    files = max(1, -(-results.count() // rows_per_file))
    write_results(results.repartitionByRange(files, "event").sortWithinPartitions("event"), path)


def input_identity(spark: SparkSession, path: str | list[str], block: int = 1 << 20) -> dict:
    """The identity of text input, equal however it is split: ``files, lines, events`` (lines that aren't blank) and ``sha256``.

    Lines are numbered, and each block of ``block`` line numbers is hashed as the digest of its lines' digests in order; a file is the
    digest of its blocks', and the input that of its files' in the order of their paths' last parts. Executors take the
    digests of lines and blocks; a row a block comes to the driver. Names of folders and line ends don't count."""
    x = numbered_lines(spark, path, keep_blank=True)
    one = x.select(F.element_at(F.split("file", "/"), -1).alias("file"), "line", F.floor((F.col("line") - 1) / F.lit(FINE)).alias("fine"), F.sha2(F.col("value").cast("binary"), 256).alias("h"), (~blank(F.col("value"))).cast("long").alias("event"))
    whole = lambda k: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(k, "h"))), lambda e: e["h"]), ""), 256).alias("h")
    fine = one.groupBy("file", "fine").agg(whole("line"), F.count("*").alias("lines"), F.sum("event").alias("events"))
    per = max(1, block // FINE)
    coarse = fine.withColumn("coarse", F.floor(F.col("fine") / per)).groupBy("file", "coarse").agg(whole("fine"), F.sum("lines").alias("lines"), F.sum("events").alias("events"))
    rows = sorted(coarse.collect(), key=lambda r: (r["file"], r["coarse"]))
    files: dict = {}
    for r in rows:
        files.setdefault(r["file"], hashlib.sha256()).update(r["h"].encode())
    total = hashlib.sha256("".join(h.hexdigest() for h in files.values()).encode()).hexdigest()
    return {"files": len(files), "lines": sum(r["lines"] for r in rows), "events": sum(r["events"] for r in rows), "sha256": total}


def provenance(source: str, **more) -> dict:
    """What a result was made from; with ``input=input_identity(..)`` also of which events."""
    return {"tool": "eventloom", "source_sha256": hashlib.sha256(source.encode()).hexdigest(), **more}


def write_json(value: dict | list, path: str) -> None:
    Path(path).write_text(json.dumps(value, indent=1))


def histogram_csv(d: dict) -> str:
    """A histogram as CSV text: edges, sum of weights, sum of squares."""
    if d["type"] == "h2":
        out, nx = ["x,y,sumw,sumw2"], d["nx"] + 2
        return "\n".join(out + [f"{i % nx},{i // nx},{w!r},{v!r}" for i, (w, v) in enumerate(zip(d["sumw"], d["sumw2"], strict=True))]) + "\n"
    e = edges(d)
    rows = [f"{a!r},{b!r},{w!r},{v!r}" for a, b, w, v in zip(e, e[1:], d["sumw"], d["sumw2"], strict=False)]
    return "\n".join(["lo,hi,sumw,sumw2", *rows]) + "\n"


def edges(d: dict) -> list[float]:
    return d["edges"] if "edges" in d else [d["lo"] + (d["hi"] - d["lo"]) * i / d["nbins"] for i in range(d["nbins"] + 1)]


def histogram_svg(d: dict, width: int = 480, height: int = 300) -> str:
    """A quick look at a histogram: steps for one axis, shaded cells for two."""
    head = f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}"><title>{d["title"].replace("&", "&amp;").replace("<", "&lt;")}</title>'
    top = max(d["sumw"], default=0) or 1.0
    if d["type"] == "h2":
        nx, ny = d["nx"], d["ny"]
        w, h = width / nx, height / ny
        cells = [f'<rect x="{i * w:.1f}" y="{height - (j + 1) * h:.1f}" width="{w:.1f}" height="{h:.1f}" fill-opacity="{max(0.0, d["sumw"][(i + 1) + (nx + 2) * (j + 1)]) / top:.3f}"/>' for i in range(nx) for j in range(ny)]
        return head + "".join(cells) + "</svg>"
    e = edges(d)
    x = lambda v: (v - e[0]) / (e[-1] - e[0]) * width
    pts = " ".join(f"{x(a):.1f},{height - s / top * height:.1f} {x(b):.1f},{height - s / top * height:.1f}" for a, b, s in zip(e, e[1:], d["sumw"], strict=False))
    return head + f'<polyline fill="none" stroke="black" points="{pts}"/></svg>'


def cutflow_text(rows: list) -> str:
    """The cutflow as a table with absolute and relative efficiencies."""
    out, last = [], None
    for r in sorted(rows, key=lambda r: (r["region"], r["step"])):
        if r["region"] != last:
            out.append(f"region {r['region']}")
            first = before = r["raw"]
            last = r["region"]
        share = lambda a, b: f"{100 * a / b:7.2f}%" if b else "      -"
        out.append(f"  {r['step']:3d} {r['label'][:60]:60s} {r['raw']:12d} {share(r['raw'], first)} {share(r['raw'], before)}" + (f"  errors {r['errors']}" if r["errors"] else ""))
        before = r["raw"]
    return "\n".join(out) + "\n"
