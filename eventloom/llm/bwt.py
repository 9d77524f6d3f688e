"""Substring dedup: repeated intervals from merged Burrows-Wheeler transforms.

A byte goes if a ``LENGTH``-byte string that covers it also starts in a document of smaller
doc_id. The work is split so that equal strings meet and little else moves:

1. A window of ``LENGTH`` bytes is named by the least hash of its ``GRAM``-byte substrings, so
   equal windows have equal names. Runs of windows with one name are segments. Distinct
   names of a document go out by name; names that two documents hold come back.
2. Those documents send the segments so named, each once for each batch of documents: of equal
   segments, the one of the smallest doc_id; the others are known to be covered.
3. Where equal names meet, equal segments combine again. Segments that share a name but
   differ, and share more than the name's bytes, are cut into shards; each shard gets its Burrows-Wheeler transform, and the
   transforms are merged by iterative interleave refinement: after round h the interleave is
   the order of all suffixes by their first h bytes, found from the transforms alone, and
   the rounds at which neighbours part give the common prefixes. After ``LENGTH`` rounds
   the intervals without a boundary are the repeated strings; each knows its smallest doc_id.
4. Removed runs go back to their documents.

Texts are dealt out by doc_id once, for all steps. A passage in a third of all documents
travels once for each batch. Equal segments are known by 112 bits of hash; what differs is
compared by bytes. Rows of one doc_id are told apart by 32 bits of their text's hash.

Null and empty texts have no bytes; texts shorter than ``LENGTH`` lose nothing; a null doc_id
is neither smaller nor larger than any, so its row loses nothing and takes nothing, and doesn't move; rows of one
doc_id don't take from each other; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LENGTH = 50
GRAM = 16
SHARD_BYTES = 1 << 15
MERGE_BYTES = 1 << 17
MEET_BYTES = 1 << 21
NO_ID = -(1 << 63)
END = 0xFF  # no UTF-8 text holds this byte
_MULT = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_INVERSE = np.uint64(pow(int(_MULT[1]), -1, 1 << 64))


def segments(texts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Segments of some texts: index of the text, first window, number of windows, name, hash of
    the bytes; and where the segment's bytes begin in the texts' concatenation."""
    sizes = np.array([len(t) for t in texts], np.int64)
    total = int(sizes.sum())
    none = np.zeros(0, np.int64)
    if total < length:
        return none, none, none, none, none, none
    b = np.frombuffer(b"".join(texts), np.uint8)
    of = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    total_to = np.concatenate((np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * power(_MULT[1], total))))
    x = grams(b)
    span, have = length - GRAM + 1, 1
    while have * 2 <= span:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    if have < span:
        x = np.minimum(x[: have - span], x[span - have :])
    x = x[: total - length + 1]
    ok = of[: len(x)] == of[length - 1 :]
    cut = np.ones(len(x), bool)
    cut[1:] = (x[1:] != x[:-1]) | (of[1 : len(x)] != of[: len(x) - 1]) | (ok[1:] != ok[:-1])
    at = np.flatnonzero(cut)
    n = np.diff(np.append(at, len(x)))
    good = ok[at]
    at, n = at[good], n[good]
    doc = of[at].astype(np.int64)
    # The sum of byte times power over the segment, shifted to begin at power zero.
    content = (total_to[at + n - 1 + length] - total_to[at]) * power(_INVERSE, total)[at]
    return doc, at - (np.cumsum(sizes) - sizes)[doc], n, (x[at] >> np.uint64(16)).astype(np.int64), content.view(np.int64), at


def grams(b: np.ndarray) -> np.ndarray:
    """The hash of each ``GRAM`` consecutive bytes."""
    x = b.astype(np.uint64) + np.uint64(1)
    for k, m in zip((1, 2, 4, 8), _MULT, strict=True):
        x = x[:-k] * m + x[k:]
    x ^= x >> np.uint64(32)
    x *= _MULT[0]
    x ^= x >> np.uint64(29)
    return x


_TABLES: dict[int, np.ndarray] = {}


def power(base: np.uint64, n: int) -> np.ndarray:
    """base ** (0..n-1) modulo 2 ** 64."""
    have = _TABLES.get(int(base))
    if have is None or len(have) < n:
        size = 1 << max(23, int(n - 1).bit_length())
        have = np.ones(size, np.uint64)
        have[1:] = base
        have = np.cumprod(have)
        if size == 1 << 23:
            _TABLES[int(base)] = have
    return have[:n]


def chunks(sizes: list[int], most: int = 1 << 22) -> Iterator[slice]:
    """Slices of a list whose members' sizes sum to about ``most``."""
    a = total = 0
    for i, s in enumerate(sizes):
        if total and total + s > most:
            yield slice(a, i)
            a, total = i, 0
        total += s
    if a < len(sizes):
        yield slice(a, len(sizes))


def transform(t: np.ndarray, depth: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """The order of a cyclic text's rotations by their first ``depth`` bytes or more, and its
    Burrows-Wheeler transform."""
    n = len(t)
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key = (key << np.uint64(8)) | np.roll(t, -k).astype(np.uint64)
    rank = np.unique(key, return_inverse=True)[1].ravel()
    have = 8
    while have < depth:
        rank = np.unique(rank.astype(np.int64) * n + np.roll(rank, -have), return_inverse=True)[1].ravel()
        have *= 2
    order = np.argsort(rank, kind="stable")
    return order, t[order - 1]


def merged(transforms: list[np.ndarray], depth: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """The interleave of some transforms and the common prefix of each merged position with the
    one before it, ``depth`` standing for that or more. A position of the interleave is given as
    the row it takes, rows of all transforms numbered one after another."""
    base, back = 0, []
    for b in transforms:  # the row of a row's suffix with the byte before it prepended
        by = np.argsort(b, kind="stable")
        lf = np.empty(len(b), np.int32)
        lf[by] = np.arange(base, base + len(b), dtype=np.int32)
        back.append(lf)
        base += len(b)
    all_, back = np.concatenate(transforms), np.concatenate(back)
    row, group, lcp = np.arange(base, dtype=np.int32), np.zeros(base, np.int32), np.zeros(base, np.uint8)
    edge = np.empty(base, bool)
    for _ in range(depth):
        char = all_[row]
        by = np.argsort(char, kind="stable")
        char, group = char[by], group[by]
        edge[0] = True
        np.not_equal(group[1:], group[:-1], out=edge[1:])
        edge[1:] |= char[1:] != char[:-1]
        lcp += ~edge  # an edge of one round is one in all that follow
        group = np.cumsum(edge, dtype=np.int32)
        row = back[row[by]]
    return row, lcp


def smallest(segs: list[np.ndarray], docs: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For each window of each segment, the smallest of the documents that hold it."""
    shards, texts = list(chunks([len(s) + 1 for s in segs], SHARD_BYTES)), []
    for s in shards:
        texts.append(np.concatenate([y for x in segs[s] for y in (x, np.array([END], np.uint8))]))
    got = [transform(t, length) for t in texts]
    row, lcp = merged([b for _, b in got], length)
    block = np.cumsum(lcp < length) - 1
    base = np.cumsum([0] + [len(t) for t in texts])
    of = np.empty(base[-1], np.int64)
    of[np.concatenate([o + a for (o, _), a in zip(got, base[:-1], strict=True)])[row]] = block
    sizes = np.array([len(s) + 1 for s in segs])
    starts, n = np.cumsum(sizes) - sizes, sizes - length
    at = np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(n.sum())
    least = np.full(block[-1] + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, of[at], np.repeat(docs, n))
    return np.split(least[of[at]], np.cumsum(n)[:-1])


def runs(covered: np.ndarray, first: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """Byte runs under the windows that are marked, the first of which starts at ``first``."""
    e = np.flatnonzero(np.diff(np.concatenate(([0], covered.view(np.int8), [0]))))
    return [(first + int(a), first + int(b) - 1 + length) for a, b in zip(e[::2], e[1::2], strict=True)]


def _names(buckets: int):
    """Step 1, mapping: for each batch, its distinct (name, smallest doc_id), by bucket of the
    name (kind 0), and the holders of names that several documents of the batch hold (1)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b[b["doc_id"] != NO_ID]
            texts, ids = list(b["text"]), b["doc_id"].to_numpy(np.int64)
            name, doc = [], []
            for c in chunks([len(t) for t in texts]):
                d, _, _, h, _, _ = segments(texts[c])
                name.append(h)
                doc.append(ids[c][d])
            if not name or not sum(map(len, name)):
                continue
            h, d = np.concatenate(name), np.concatenate(doc)
            by = np.lexsort((d, h))
            h, d = h[by], d[by]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
            h, d = h[new], d[new]
            head = np.ones(len(h), bool)
            head[1:] = h[1:] != h[:-1]
            group = np.cumsum(head) - 1
            many = np.bincount(group)[group] > 1
            to = h % buckets
            out = [(k, 0, p) for k, p in _dealt(to[head], h[head], d[head])]
            out += [(k, 1, p) for k, p in _dealt(d[many] % buckets, h[many], d[many])]
            yield pd.DataFrame(out, columns=["bucket", "kind", "data"])

    return run


def _stretches(a: np.ndarray) -> list[tuple[int, int]]:
    """Where each stretch of equal values of a sorted array begins and ends."""
    if not len(a):
        return []
    cuts = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1], [True])))
    return list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))


def _dealt(to: np.ndarray, h: np.ndarray, d: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(name, doc_id) pairs by bucket: names in six bytes, ids as offsets where these fit."""
    by = np.argsort(to, kind="stable")
    to, h, d = to[by], h[by], d[by]
    for a, b in _stretches(to):
        low, high = int(d[a:b].min()), int(d[a:b].max())
        wide = high - low >= 1 << 32
        ids = (d[a:b] - (0 if wide else low)).astype(np.int64 if wide else np.uint32)
        yield int(to[a]), struct.pack("<qiB", low, b - a, wide) + h[a:b].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes() + ids.tobytes()


def _pairs(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    low, n, wide = struct.unpack_from("<qiB", data)
    h = np.zeros((n, 8), np.uint8)
    h[:, :6] = np.frombuffer(data, np.uint8, 6 * n, 13).reshape(-1, 6)
    d = np.frombuffer(data, np.int64 if wide else np.uint32, n, 13 + 6 * n).astype(np.int64)
    return h.reshape(-1).view("<u8").astype(np.int64), d if wide else d + low


def _by_bucket(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of one bucket after another, from rows sorted by it."""
    held: list[pd.DataFrame] = []
    for b in batches:
        cuts = np.flatnonzero(np.diff(b["bucket"].to_numpy())) + 1
        for part in (b.iloc[i:j] for i, j in zip([0, *cuts], [*cuts, len(b)], strict=True) if j > i):
            if held and held[0]["bucket"].iloc[0] != part["bucket"].iloc[0]:
                yield pd.concat(held)
                held = []
            held.append(part)
    if held:
        yield pd.concat(held)


def _shared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Step 1, meeting: (doc_id, name) of names that two documents hold."""
    for b in _by_bucket(batches):
        for kind, part in b.groupby("kind"):
            got = [_pairs(x) for x in part["data"]]
            h, d = np.concatenate([x for x, _ in got]), np.concatenate([x for _, x in got])
            if kind == 0:
                by = np.lexsort((d, h))
                h, d = h[by], d[by]
                new = np.concatenate(([True], h[1:] != h[:-1]))
                group = np.cumsum(new) - 1
                first, last = d[new], d[np.append(np.flatnonzero(new)[1:] - 1, len(d) - 1)]
                keep = (first < last)[group]
                h, d = h[keep], d[keep]
            yield pd.DataFrame({"doc_id": d, "name": h})


def _take(b: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of some pieces of b, one after another."""
    return b[np.repeat(at - (np.cumsum(size) - size), size) + np.arange(size.sum())]


def _packed(*columns: np.ndarray, data: np.ndarray) -> bytes:
    head = struct.pack("<q", len(columns[0])) + b"".join(c.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes() for c in columns)
    return zstandard.ZstdCompressor(level=3).compress(head + data.tobytes())


def _unpacked(blob: bytes, columns: int) -> tuple[list[np.ndarray], np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    n = int(raw[:8].view("<i8")[0])
    cols = [np.ascontiguousarray(raw[8 + 8 * n * i : 8 + 8 * n * (i + 1)].reshape(8, n).T).reshape(-1).view("<i8") for i in range(columns)]
    return cols, raw[8 + 8 * n * columns :]


def _content(flat: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The hash that ``segments`` gives pieces of some bytes, from the bytes."""
    out, cut = np.empty(len(at), np.int64), 0
    while cut < len(at):  # in stretches of a few MB, so that tables of powers stay small
        end = max(cut + 1, int(np.searchsorted(at, at[cut] + (1 << 22))))
        low, high = int(at[cut]), int(at[end - 1] + size[end - 1])
        x = flat[low:high].astype(np.uint64) + np.uint64(1)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(x * power(_MULT[1], len(x)))))
        a = at[cut:end] - low
        out[cut:end] = ((total[a + size[cut:end]] - total[a]) * power(_INVERSE, len(x))[a]).view(np.int64)
        cut = end
    return out


def _spans(doc: np.ndarray, th: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """Runs of bytes by document, touching ones joined."""
    by = np.lexsort((start, th, doc))
    doc, th, start, end = doc[by], th[by], start[by], end[by]
    if not len(doc):
        return
    new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (th[1:] != th[:-1])))
    # Within a document ends rise with starts but for equal names; the running maximum keeps documents apart.
    far = np.maximum.accumulate(end + (np.cumsum(new) << 40)) - (np.cumsum(new) << 40)
    head = new | np.concatenate(([True], start[1:] > far[:-1]))
    first = np.flatnonzero(head)
    last = np.append(first[1:], len(doc)) - 1
    a, b, d, t = start[first], far[last], doc[first], th[first]
    cuts = np.flatnonzero(new[first])
    for i, j in zip(cuts, [*cuts[1:], len(first)], strict=True):
        yield int(d[i]), int(t[i]), np.stack([a[i:j], b[i:j]]).astype("<i8").tobytes()


def may_meet(b: np.ndarray, size: np.ndarray, name: np.ndarray, docs: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Which of some segments, one after another in ``b``, may hold a window that one of another document holds. An equal window
    has the name's gram at the same place, so of its other bytes the first or last two thirds, or the middle, are about that gram;
    a segment that shares none of these three pieces with another document's is left out. One that has the gram twice stays."""
    out = np.ones(len(size), bool)
    at = np.cumsum(size) - size
    of = np.repeat(np.arange(len(size)), size)[: max(0, len(b) - GRAM + 1)]
    hit = np.flatnonzero((grams(b) >> np.uint64(16)).astype(np.int64) == name[of]) if len(of) else np.zeros(0, np.int64)
    single = np.bincount(of[hit], minlength=len(size)) == 1
    gram = np.zeros(len(size), np.int64)
    gram[of[hit]] = hit - at[of[hit]]
    out[single] = False
    third = (length - GRAM) // 3
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * power(_MULT[1], len(b)))))
    shift = power(_INVERSE, len(b))
    for before in (length - GRAM - third, third, 0):
        # A window with ``before`` bytes or more ahead of the gram, but fewer than the last piece needs, has the rest behind it.
        after = {third: length - GRAM - 2 * third, 0: length - GRAM - third + 1}.get(before, 0) + GRAM
        k = np.flatnonzero(single & (gram >= before) & (gram + after <= size))
        if not len(k):
            continue
        a = at[k] + gram[k] - before
        h = (total[a + before + after] - total[a]) * shift[a]
        by = np.argsort(h, kind="stable")
        new = np.concatenate(([True], h[by][1:] != h[by][:-1]))
        first, d = np.flatnonzero(new), docs[k][by]
        met = np.minimum.reduceat(d, first) < np.maximum.reduceat(d, first)
        out[k[by[met[np.cumsum(new) - 1]]]] = True
    return out


_OUT = ["bucket", "kind", "doc_id", "th", "data"]


def _sent(buckets: int):
    """Step 2: named segments by bucket of the name (kind 0), and runs of bytes that the batch holds
    in a smaller document, by document (kind 1)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids, ths, texts = b["doc_id"].to_numpy(np.int64), b["th"].to_numpy(np.int64), list(b["text"])
            wanted, cols, data = list(b["names"]), [], []
            for c in chunks([len(t) for t in texts]):
                doc, first, n, name, content, at = segments(texts[c])
                many = [np.unique(np.asarray(w, np.int64)) for w in wanted[c]]
                keys = (np.concatenate(many) << 15 if len(many) < 1 << 15 else np.concatenate(many)) if many else np.zeros(0, np.int64)
                if len(many) < 1 << 15:
                    on = np.isin(name << 15 | doc, keys | np.repeat(np.arange(len(many)), [len(x) for x in many]))
                else:
                    on = np.isin(name, keys)  # too many to number; a few more segments travel
                doc, first, n, name, content, at = (x[on] for x in (doc, first, n, name, content, at))
                cols.append((ids[c][doc], ths[c][doc], first, n, name, content))
                data.append(_take(np.frombuffer(b"".join(texts[c]), np.uint8), at, n - 1 + LENGTH))
            if not cols:
                continue
            doc, th, first, n, name, content = (np.concatenate(x) for x in zip(*cols, strict=True))
            flat, size = np.concatenate(data), n - 1 + LENGTH
            least = _least(name, content, n, doc)[0]
            known = doc > least
            out = [(d % buckets, 1, d, t, x) for d, t, x in _spans(doc[known], th[known], first[known], first[known] + size[known])]
            at = (np.cumsum(size) - size)[~known]
            keep = [x[~known] for x in (name, doc, th, first, n)]
            by = np.lexsort((keep[0], keep[0] % buckets))
            to = (keep[0] % buckets)[by]
            for i, j in _stretches(to):
                some = by[i:j]
                out.append((int(to[i]), 0, 0, 0, _packed(*[x[some] for x in keep], data=_take(flat, at[some], keep[4][some] - 1 + LENGTH))))
            yield pd.DataFrame(out, columns=_OUT)

    return run


def _least(name: np.ndarray, content: np.ndarray, n: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each segment the smallest doc_id that holds an equal one, and the number of its kind. Equal means
    of one name, length and hash of the bytes: 112 bits besides the length."""
    by = np.lexsort((doc, n, content, name))
    a, b, c = name[by], content[by], n[by]
    new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1]))) if len(by) else np.zeros(0, bool)
    kind = np.empty(len(by), np.int64)
    kind[by] = np.cumsum(new) - 1
    return doc[by][new][kind], kind


def _removed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Step 3: removed byte runs, by document."""
    for b in _by_bucket(batches):
        ready = b[b["kind"] == 1]
        out = list(zip(ready["doc_id"], ready["th"], ready["data"], strict=True))
        got = [_unpacked(x, 5) for x in b.loc[b["kind"] == 0, "data"]]
        if got:
            name, doc, th, first, n = (np.concatenate(x) for x in zip(*[c for c, _ in got], strict=True))
            flat, size = np.concatenate([d for _, d in got]), n - 1 + LENGTH
            at = np.cumsum(size) - size
            least, kind = _least(name, _content(flat, at, size), n, doc)
            whole = doc > least
            rows = [(doc[whole], th[whole], first[whole], (first + size)[whole])]
            # One segment of each kind, where its name has several kinds.
            one = np.unique(kind, return_index=True)[1]
            one = one[np.bincount(np.unique(name[one], return_inverse=True)[1])[np.unique(name[one], return_inverse=True)[1]] > 1]
            one = one[np.argsort(name[one], kind="stable")]
            groups, some = _stretches(name[one]), [np.zeros(0, bool)]
            for c in chunks([int(size[one[i:j]].sum()) for i, j in groups], MEET_BYTES):
                part = one[groups[c.start][0] : groups[c.stop - 1][1]]
                some.append(may_meet(_take(flat, at[part], size[part]), size[part], name[part], least[part]))
            one = one[np.concatenate(some)]
            groups = _stretches(name[one])
            open_ = np.flatnonzero(~whole)
            open_ = open_[np.argsort(kind[open_], kind="stable")]
            kinds = kind[open_]
            for c in chunks([int(size[one[i:j]].sum()) for i, j in groups], MERGE_BYTES):
                part = one[groups[c.start][0] : groups[c.stop - 1][1]]
                w = smallest([flat[i : i + s] for i, s in zip(at[part], size[part], strict=True)], least[part])
                low = np.concatenate(w) < np.repeat(least[part], n[part])
                # Covered windows of each kind apply to its segments in the kind's smallest document.
                ends = np.cumsum(n[part])
                some = np.flatnonzero(np.add.reduceat(low, ends - n[part]) > 0)
                from_, to = (np.searchsorted(kinds, kind[part[some]], side) for side in ("left", "right"))
                for k, i, j in zip(some, from_, to, strict=True):
                    for same in open_[i:j]:
                        for x, y in runs(low[ends[k] - n[part[k]] : ends[k]], int(first[same])):
                            rows.append(([doc[same]], [th[same]], [x], [y]))
            out += _spans(*(np.concatenate(x).astype(np.int64) for x in zip(*rows, strict=True)))
        yield pd.DataFrame(out, columns=["doc_id", "th", "data"])


def union(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return out


def _judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Step 4."""
    for b in batches:
        rows = []
        for t, th, spans in zip(b["text"], b["th"], b["spans"], strict=True):
            gone = union([x for s in spans if s["th"] == th for x in np.frombuffer(s["data"], "<i8").reshape(2, -1).T.tolist()]) if spans is not None else []
            kept, at = [], 0
            for x, y in gone:
                kept.append(t[at:x])
                at = y
            kept.append(t[at:])
            kept = b"".join(kept)
            rows.append((len(t), len(t) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), [x for g in gone for x in g]))
        yield pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"]).assign(doc_id=b["doc_id"].to_numpy())


def deduplicated(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed`` for every row; removed has
    the start and end of each removed run in turn."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = 4 * parts
    id_, kind = F.col("doc_id").cast("long"), docs.schema["doc_id"].dataType
    every = docs.select(id_.alias("doc_id"), F.xxhash64("text").bitwiseAND(F.lit((1 << 32) - 1)).alias("th"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    t = every.where("doc_id is not null").repartition(parts, "doc_id")
    nameless = every.where("doc_id is null").select(F.lit(NO_ID).alias("doc_id"), "th", "text", F.lit(None).cast("array<struct<th:long,data:binary>>").alias("spans"))

    names = t.mapInPandas(_names(buckets), "bucket long, kind int, data binary").repartition(parts, "bucket").sortWithinPartitions("bucket")
    shared = names.mapInPandas(_shared, "doc_id long, name long").groupBy("doc_id").agg(F.collect_list("name").alias("names"))
    named = t.join(shared.hint("shuffle_hash"), "doc_id").select("doc_id", "th", "text", "names")
    sent = named.mapInPandas(_sent(buckets), "bucket long, kind int, doc_id long, th long, data binary").repartition(parts, "bucket").sortWithinPartitions("bucket")
    gone = sent.mapInPandas(_removed, "doc_id long, th long, data binary").groupBy("doc_id").agg(F.collect_list(F.struct("th", "data")).alias("spans"))
    x = t.join(gone.hint("shuffle_hash"), "doc_id", "left").select("doc_id", "th", "text", "spans")
    judged = lambda df: df.mapInPandas(_judged, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<long>")
    return judged(x).unionByName(judged(nameless)).withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).cast(kind))
