"""Suffix-array removal of repeated byte strings.

Shards of candidate stretches (see repeats) are indexed by induced sorting: suffixes are classified as smaller or larger than
their right neighbour, the leftmost-smaller ones are sorted by recursion on their names, all others are induced from
them bucket by bucket in linear time, and permuted common prefixes give the repeats. The loops over a bucket are NumPy
calls on whole runs of suffixes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import repeats as R

WINDOW = 400


def classify(t: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next one. The last symbol is a sentinel, below all that it equals."""
    n = len(t)
    edge = np.flatnonzero(np.append(t[1:] != t[:-1], True))
    rises = np.ones(len(edge), bool)
    rises[:-1] = t[edge[:-1]] < t[edge[:-1] + 1]
    return np.repeat(rises, np.diff(edge, prepend=-1)) if n else np.zeros(0, bool)


def _dense(rank: np.ndarray, key: np.ndarray, active: np.ndarray) -> np.ndarray:
    """Refines rank (the place of a group's first member) by key within the groups of the active members."""
    old = rank[active]
    order = np.lexsort((key, old))
    g, k = old[order], key[order]
    i = np.arange(len(g))
    new_group = np.ones(len(g), bool)
    new_group[1:] = g[1:] != g[:-1]
    at = i - np.maximum.accumulate(np.where(new_group, i, 0))
    first = new_group.copy()
    first[1:] |= k[1:] != k[:-1]
    place = g + at
    rank[active[order]] = place[np.maximum.accumulate(np.where(first, i, 0))]
    return rank


def _tied(rank: np.ndarray) -> np.ndarray:
    count = np.bincount(rank, minlength=len(rank))
    return np.flatnonzero(count[rank] > 1)


def sorted_lms(t: np.ndarray, lms: np.ndarray, depth: int) -> np.ndarray:
    """The leftmost-smaller positions in the order of their suffixes, equal up to `depth` symbols in any order.

    Substrings from one such position to the next are named by packed chunks of eight symbols (after its end a substring
    counts as larger); then names are sorted recursively, each round joining twice as many.
    """
    m = len(lms)
    ends = np.append(lms[1:] + 1, len(t))
    pad = np.concatenate((t, np.full(16, 255, np.uint8)))

    def packed(start: np.ndarray, end: np.ndarray) -> np.ndarray:
        out = np.zeros(len(start), C.U64)
        for j in range(8):
            out = out << C.U64(8) | np.where(start + j < end, pad[np.minimum(start + j, len(t))], 255).astype(C.U64)
        return out

    first = packed(lms, ends)
    first[-1] = 0  # the sentinel
    rank = _dense(np.zeros(m, np.int64), first, np.arange(m))
    at = 8
    while True:
        tied = _tied(rank)
        # a member that ends just here counts as larger than a longer one; those that ended before differ by their padding
        tied = tied[lms[tied] + at <= ends[tied]] if len(tied) else tied
        if not len(tied):
            break
        rank = _dense(rank, packed(lms[tied] + at, ends[tied]), tied)
        at += 8
    hop = 1
    while len(tied := _tied(rank)):
        # a text of `depth` symbols is compared in whole
        reach = np.where(tied + hop < m, lms[np.minimum(tied + hop, m - 1)] - lms[tied], depth)
        tied = tied[reach < depth] if (reach < depth).any() else tied[:0]
        if not len(tied):
            break
        rank = _dense(rank, np.where(tied + hop < m, rank[np.minimum(tied + hop, m - 1)], -1), tied)
        hop *= 2
    return lms[np.argsort(rank, kind="stable")]


def suffix_array(t: np.ndarray, depth: int) -> np.ndarray:
    """Suffix array of uint8 symbols that end in a 0, no two zeros in a row; suffixes equal in `depth` symbols may stand in any order."""
    n = len(t)
    if n < 2:
        return np.arange(n)
    small = classify(t)
    is_lms = np.zeros(n, bool)
    is_lms[1:] = small[1:] & ~small[:-1]
    lms = np.flatnonzero(is_lms)
    count = np.bincount(t, minlength=256)
    tail = np.cumsum(count)
    head = tail - count
    order = sorted_lms(t, lms, depth)
    by = t[order]
    bound = np.searchsorted(by, np.arange(257))
    sa = np.full(n, -1, np.int64)
    fill = head.copy()

    def put(found: np.ndarray, forward: bool) -> None:
        c = t[found]
        k = np.argsort(c, kind="stable")
        c, found = c[k].astype(np.int64), found[k]
        many = np.bincount(c, minlength=256)
        i = np.arange(len(c)) - (np.cumsum(many) - many)[c]
        if forward:
            sa[fill[c] + i] = found
            fill[:] += many
        else:
            sa[fill[c] - 1 - i] = found
            fill[:] -= many

    for c in np.flatnonzero(count):
        at = head[c]
        while at < fill[c]:
            block, at = sa[at : fill[c]] - 1, fill[c]
            block = block[block >= 0]
            put(block[~small[block]], True)
        block = order[bound[c] : bound[c + 1]] - 1
        put(block[block >= 0], True)
    larger = fill.copy()
    fill = tail.copy()
    sa[0] = n - 1
    for c in np.flatnonzero(count)[::-1]:
        if not c:
            break
        at = tail[c]
        while at > fill[c]:
            block, at = sa[fill[c] : at][::-1] - 1, fill[c]
            block = block[block >= 0]
            put(block[small[block]], False)
        block = sa[head[c] : larger[c]][::-1] - 1
        block = block[block >= 0]
        put(block[small[block]], False)
    return sa


def permuted_prefixes(t: np.ndarray, sa: np.ndarray, cap: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Of each position: the common prefix (up to cap) with the suffix before it in sa, and that suffix.

    Compared in eight-byte steps only where a common prefix can't follow from its left neighbour's by one less.
    """
    n = len(t)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    ok = before >= 0
    head = ok.copy()
    b1 = np.maximum(before - 1, 0)
    head[1:] &= ~(ok[:-1] & (before[1:] == before[:-1] + 1) & (t[:-1] == t[b1[1:]]))
    i = np.flatnonzero(head)
    j = before[i]
    wide = np.zeros(n + 8, np.uint8)
    wide[:n] = t
    words = np.lib.stride_tricks.as_strided(wide.view(np.uint8), (n + 1, 8), (1, 1))
    size = np.zeros(n, np.int64)
    live, x, y = np.arange(len(i)), i.copy(), j.copy()
    total = np.zeros(len(i), np.int64)
    while len(live):
        same = words[x] == words[y]
        some = np.where(same.all(axis=1), 8, same.argmin(axis=1))
        room = n - np.maximum(x, y)
        some = np.minimum(some, room)
        total[live] += some
        go = (some == 8) & (total[live] < cap) & (room > 8)
        live, x, y = live[go], x[go] + 8, y[go] + 8
    size[i] = total
    at = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    return np.where(ok, np.maximum(size[at] - (np.arange(n) - at), 0), 0), before


def repeated_in_shard(stretches: list[bytes], window: int = WINDOW) -> dict[int, list[tuple[int, int]]]:
    """Runs of starts, by stretch, of windows that start at two places or more of the shard."""
    size = np.array([len(x) for x in stretches])
    t = np.frombuffer(b"\0".join([*stretches, b""]), np.uint8).copy()
    ends = np.cumsum(size + 1)
    begin = ends - size - 1
    body = np.ones(len(t), bool)
    body[ends - 1] = False
    t[body] += 1  # UTF-8 has no byte 255; 0 separates
    prefix, before = permuted_prefixes(t, suffix_array(t, window))
    hit = np.flatnonzero(prefix >= window)
    again = np.zeros(len(t), bool)
    again[hit] = True
    again[before[hit]] = True
    again &= body
    start = np.flatnonzero(again)
    which = np.searchsorted(begin, start, "right") - 1
    ok = start + window <= ends[which] - 1
    start, which = start[ok], which[ok]
    out: dict[int, list[tuple[int, int]]] = {}
    if len(start):
        cut = np.flatnonzero((np.diff(start) != 1) | (np.diff(which) != 0)) + 1
        for a, b in zip([0, *cut], [*cut, len(start)], strict=True):
            i = int(which[a])
            out.setdefault(i, []).append((int(start[a] - begin[i]), int(start[b - 1] - begin[i])))
    return out


def _byte_units(raw: np.ndarray, offsets: np.ndarray):
    return C.BYTE_VALUES[raw], offsets, raw


def cut_bytes(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k1, k2, text, copied, marks in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                data = text.encode()
                runs = [(0, len(data))] if copied and len(data) >= window else R.covered(marks, window)
                kept, at = hashlib.sha256(), 0
                for a, b in [*runs, (len(data), 0)]:
                    kept.update(data[at:a])
                    at = b
                rows.append((k1, k2, len(data), sum(b - a for a, b in runs), len(runs), kept.hexdigest(), [{"first": a, "last": b} for a, b in runs]))
            yield pa.RecordBatch.from_pylist([dict(zip(("k1", "k2", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"), r, strict=True)) for r in rows], CUT) if rows else pa.RecordBatch.from_pylist([], CUT)

    return run


CUT = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])))])


def suffix_array_dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Removes every byte covered by a `window`-byte string that also starts anywhere else in the corpus.

    docs: doc_id, text (other columns are ignored). Returns, for each row of docs, doc_id, n_bytes, n_removed, n_spans, kept_sha256 and
    spans (the removed byte runs, last exclusive). A null or empty text has no bytes and loses none. Rows with one text,
    repeated rows included, are copies of each other: each is removed whole if it is long enough. A null doc_id stays.
    An empty table gives an empty result.
    """
    plan = R.Plan(window, min(32, window), max(1, -(-(window - 31) // 3)), max(1, -(-(window - 31) // 48)), _byte_units, lambda s: repeated_in_shard(s, window))
    schema = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<first: long, last: long>>"
    return R.remove_repeats(docs.select("doc_id", "text"), plan, 1, cut_bytes(window), schema)
