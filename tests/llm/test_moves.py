"""What moves: a plan's exchanges of whole texts."""

import numpy as np
import pandas as pd

from eventloom.llm import bwt


def test_suffix_dedup_deals_texts_once(spark, tmp_path):
    rows = [(i, f"text {i % 7} " * 20) for i in range(40)] + [(None, "text 1 " * 20)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    df = bwt.deduplicated(spark.read.parquet(str(tmp_path / "d")))
    assert df.count() == 41
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0]
    assert plan.count("FileScan") == 2  # with ids, and without


def test_suffix_merges_look_at_their_own_segments(monkeypatch):
    """The cost of a merge is that of its own segments: the bucket's are not searched again in each."""
    n, length = 400, bwt.LENGTH
    rng = np.random.default_rng(1)
    name, doc = np.repeat(np.arange(n), 2), np.arange(2 * n)
    flat = rng.integers(97, 123, (n, length + 10), dtype=np.uint8).repeat(2, 0)
    flat[1::2, -1] = 48
    size = np.full(2 * n, 11)
    packed = bwt._packed(name, doc, 0 * doc, 0 * doc, size, data=flat.reshape(-1))
    b = pd.DataFrame([(0, 0, 0, 0, packed)], columns=bwt._OUT)
    monkeypatch.setattr(bwt, "MERGE_BYTES", 1)
    calls = []
    plain = np.isin
    monkeypatch.setattr(np, "isin", lambda a, *rest: (calls.append(len(a)), plain(a, *rest))[1])
    got = pd.concat(bwt._removed(iter([b])))
    assert sorted(got["doc_id"]) == list(range(1, 2 * n, 2))
    assert all(np.frombuffer(d, "<i8").tolist() == [0, length + 9] for d in got["data"])
    assert sum(calls) <= 2 * n


def test_only_segments_that_may_share_a_window_are_merged():
    """Segments of one name that differ on all sides of its gram take no part in a merge; none that shares a window is lost."""
    r = np.random.default_rng(7)
    words = [bytes(r.integers(97, 123, 9).astype(np.uint8)) for _ in range(12)]
    texts = [b" ".join(words[i] for i in r.integers(0, 12, 60)) for _ in range(80)]
    doc, first, n, name, _, at = bwt.segments(texts)
    flat = np.frombuffer(b"".join(texts), np.uint8)
    by = np.argsort(name, kind="stable")
    doc, n, name, at = doc[by], n[by], name[by], at[by]
    size = n - 1 + bwt.LENGTH
    kept = bwt.may_meet(bwt._take(flat, at, size), size, name, doc)
    holders: dict[bytes, set[int]] = {}
    for d, a, k in zip(doc, at, n, strict=True):
        for i in range(k):
            holders.setdefault(flat[a + i : a + i + bwt.LENGTH].tobytes(), set()).add(int(d))
    shares = np.array([any(len(holders[flat[a + i : a + i + bwt.LENGTH].tobytes()]) > 1 for i in range(k)) for a, k in zip(at, n, strict=True)])
    assert shares.any() and not (shares & ~kept).any()
    several = np.unique(name, return_inverse=True)[1]
    crowd = np.bincount(several)[several] > 1
    assert (crowd & ~kept).sum() > (crowd & ~shares).sum() / 2
