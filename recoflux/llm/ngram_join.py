"""N-gram Jaccard join by token-combination prefixes.

Texts are sets of 5-word shingles (tokens); two texts link at a Jaccard similarity of 0.8 or more. Tokens stand in one order, rare
ones first by a corpus-wide count sketch of fixed size. A set's extended prefix (one token longer than the plain one) shares two tokens with any
linked set's. So linked sets share a rare token, each indexed alone, or two tokens of the frequent class, indexed by pairs. Sets with
more than DENSE frequent tokens in the prefix index those singly in a key space of their own, in which the other sets only look them up.

Clusters of near copies would put each of their sets into the same hundreds of keys. So they are joined first: sets of about one size that
agree in a minimum hash are verified against one leader of their group, and the links found make components. The index then holds each set with its
component, and a key whose sets are all of one component is dropped before any row of it is made. This only saves work: every key with two
components or more is verified in full, every pair of different components that sizes and token histograms allow. Keys with more than
BLOCK sets are verified in pairs of blocks.

Sets live in one table in the shared folder, bucketed by their hash, so that no join by it exchanges their texts again.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .components import components

SHINGLE = 5
PERCENT = 80
SKETCH_BITS = 24  # counters of the sketch; a byte each, the power of two, in a broadcast
SLICES = 64
DENSE = 16
BLOCK = 4096
RARE_MOST = 2048  # sets that the sketch may count for a token that is indexed alone
MINIMA = 3
MEMBERS = 1024  # sets that are verified against one copy of their leader
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_sets(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, shingle hash) of the distinct shingles of each text, sorted; a shorter text is one shingle."""
    raw = _LOWER[raw]
    starts, ends, at = C.word_spans(raw, offsets)
    n = len(starts)
    each = C.word_hashes(raw, starts, ends)
    words = np.diff(at)
    text = np.repeat(np.arange(len(words)), words)
    i = np.arange(n)
    full = i + SHINGLE <= at[text + 1]
    a, t = i[full], text[full]
    short = np.flatnonzero((words > 0) & (words < SHINGLE))
    found, of = [C.window_hashes(each, a, SHINGLE)], [t]
    for k in range(1, SHINGLE):
        i = short[words[short] == k]
        found.append(C.window_hashes(each, at[i], k))
        of.append(i)
    h, t = np.concatenate(found), np.concatenate(of)
    order = _by_text(t, h)
    h, t = h[order], t[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
    return t[new], h[new]


def _by_text(t: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The order by (t, h), from one sort of 64-bit keys unless they leave it open."""
    if len(t) and int(t.max()) < 1 << 16:
        key = t.astype(C.U64) << C.U64(48) | h >> C.U64(16)
        order = np.argsort(key)
        key = key[order]
        tie = np.flatnonzero(key[1:] == key[:-1])
        if (h[order[tie]] == h[order[tie + 1]]).all():
            return order
    return np.lexsort((h, t))


def _nodes(text: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each text's set, and the set's size."""
    at = np.searchsorted(text, np.arange(n + 1))
    sums = np.concatenate((np.zeros(1, C.U64), np.cumsum(C.mix(h ^ C.U64(0x5E7)))))
    return C.mix(sums[at[1:]] - sums[at[:-1]] + np.diff(at).astype(C.U64)), np.diff(at)


_TABLE = "kind int, bk long, doc_id long, n long, " + ", ".join(f"m{j} long" for j in range(MINIMA)) + ", z binary, hist binary, slice int, counts binary"
DOC, SET, COUNTS = 0, 1, 2  # kinds of rows


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each text (bk deals them evenly), one for each set that is new to the task (bk is its hash), and the task's count sketch of tokens in slices."""
    counts = np.zeros(1 << SKETCH_BITS, np.uint16)  # of this task; 255 is enough to order tokens
    seen: set[int] = set()
    to, passed = zstandard.ZstdCompressor(level=1), 0
    names = [x.split()[0] for x in _TABLE.split(", ")]
    types = dict(zip(names, [pa.int32(), *[pa.int64()] * (3 + MINIMA), pa.binary(), pa.binary(), pa.int32(), pa.binary()], strict=True))

    def out(m: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[k] if isinstance(columns.get(k), pa.Array) else pa.array(columns[k], types[k]) if k in columns else pa.nulls(m, types[k]) for k in names], names=names)

    for batch in batches:
        for a, b, raw, offsets in C.pieces(batch.column(1)):
            text, h = shingle_sets(raw, offsets)
            m = b - a
            node, n = _nodes(text, h, m)
            node &= ~C.U64(1)
            dealt = C.mix(node + np.arange(passed, passed + m).astype(C.U64))
            passed += m
            yield out(m, kind=np.full(m, DOC, np.int32), bk=dealt.view(np.int64), doc_id=batch.column(0).slice(a, m), n=n, slice=pa.nulls(m, pa.int32()), m0=node.view(np.int64))
            new = np.array([k > 0 and x not in seen and not seen.add(x) for x, k in zip(node.tolist(), n.tolist(), strict=True)], bool)
            tokens = h[new[text]]
            at = (tokens >> C.U64(64 - SKETCH_BITS)).astype(np.int64)
            for i in range(0, len(at), 1 << 15):  # a counter stays below 2 ** 16
                np.add.at(counts, at[i : i + (1 << 15)], 1)
                counts[at[i : i + (1 << 15)]] = np.minimum(counts[at[i : i + (1 << 15)]], 255)
            some = np.flatnonzero(new)
            if len(some):
                at = np.searchsorted(text, np.arange(m + 1))
                minima = {f"m{j}": np.minimum.reduceat(C.mix(tokens ^ C.U64(j * 0x9E3779B9 + 77)), np.cumsum(n[some]) - n[some]).view(np.int64) for j in range(MINIMA)}
                data = raw.tobytes()
                yield out(len(some), kind=np.full(len(some), SET, np.int32), bk=node[some].view(np.int64), n=n[some], **minima, z=[to.compress(data[offsets[i] : offsets[i + 1]]) for i in some], hist=[_histogram(h[at[i] : at[i + 1]]) for i in some])
    if seen:
        parts = counts.astype(np.uint8).reshape(SLICES, -1)
        yield out(SLICES, kind=np.full(SLICES, COUNTS, np.int32), bk=np.arange(SLICES), slice=np.arange(SLICES, dtype=np.int32), counts=[zstandard.compress(x.tobytes(), 1) for x in parts])


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x = np.frombuffer(zstandard.decompress(blob), np.uint8)
            total[k] = total[k] + x if k in total else x.astype(np.uint32)
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([zstandard.compress(x.tobytes(), 1) for x in total.values()], pa.binary())], names=["slice", "counts"])


def _sketch(described: DataFrame) -> tuple[np.ndarray, float]:
    """The power of two of each summed counter, 2 ** SKETCH_BITS bytes whatever the input, and the mean count."""
    out, total = np.zeros((SLICES, (1 << SKETCH_BITS) // SLICES), np.uint8), 0.0
    parts = described.select("slice", "counts").repartition(SLICES, "slice").mapInArrow(C.lean(_add), "slice int, counts binary")
    for r in parts.toLocalIterator():
        x = np.frombuffer(zstandard.decompress(bytes(r["counts"])), np.uint32)
        out[r.slice] = np.frexp(x.astype(np.float32))[1]
        total += float(x.sum(dtype=np.uint64))
    return out.ravel(), total / (1 << SKETCH_BITS)


def prefix_keys(text: np.ndarray, h: np.ndarray, n: int, level: np.ndarray, frequent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, key, role) of the index entries; role 1 only looks others up. level: the power of two of each token's count in the sketch."""
    if n < 1 << 16:  # h ascends within a text, so places stand for it
        order = np.sort((text.astype(C.U64) << C.U64(8) | level.astype(C.U64)) << C.U64(40) | np.arange(len(h), dtype=C.U64))
        order = (order & C.U64((1 << 40) - 1)).astype(np.int64)
    else:
        order = np.lexsort((h, level, text))
    t, k, f = text[order], h[order], level[order] > frequent
    at = np.searchsorted(t, np.arange(n + 1))
    size = np.diff(at)
    take = size - -(-PERCENT * size // 100) + 2
    take = np.where(size >= 4, np.minimum(take, size), 0)  # of smaller sets only equal ones link
    keep = C.ranges(at[:-1], take)
    t, k, f = t[keep], k[keep], f[keep]
    out = [(t[~f], k[~f], np.zeros((~f).sum(), np.int64))]
    ft, fk = t[f], k[f]
    if len(ft):
        many = np.bincount(ft, minlength=n)
        dense = many[ft] > DENSE
        out.append((ft, C.mix(fk ^ C.U64(0xDE45E)), np.where(dense, 0, 1)))
        for gap in range(1, DENSE):
            i = np.arange(len(ft) - gap)
            i = i[(ft[i] == ft[i + gap]) & ~dense[i]]
            if len(i):
                a, b = np.minimum(fk[i], fk[i + gap]), np.maximum(fk[i], fk[i + gap])
                out.append((ft[i], C.mix(a * C.U64(0x9E3779B97F4A7C15) ^ C.mix(b)), np.zeros(len(i), np.int64)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _index(sketch, frequent: int, parts: int):
    """Rows (node, label, compressed text) -> (part, blob): the entries (key, node, label, role) of a piece for each of `parts` ranges of keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, of = sketch.value, zstandard.ZstdDecompressor()
        for whole in batches:
            for i in range(0, len(whole), 512):
                batch = whole.slice(i, 512)
                node, label = (batch.column(k).to_numpy().view(C.U64) for k in (0, 1))
                texts = pa.array([of.decompress(x) if x else b"" for x in batch.column(2).to_pylist()], pa.binary())
                for a, b, raw, offsets in C.pieces(texts, 4 * C.CHUNK):
                    text, h = shingle_sets(raw, offsets)
                    t, key, role = prefix_keys(text, h, b - a, counts[(h >> C.U64(64 - SKETCH_BITS)).astype(np.int64)], frequent)
                    part = ((key >> C.U64(32)) * C.U64(parts) >> C.U64(32)).astype(np.int64)
                    order = np.argsort(part.astype(np.uint16) if parts < 1 << 16 else part, kind="stable")
                    rows = np.stack([key, node[a + t] & ~C.U64(1) | role.astype(C.U64), label[a + t]], axis=1)[order]
                    at = np.searchsorted(part[order], np.arange(parts + 1))
                    some = np.flatnonzero(np.diff(at))
                    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([rows[at[k] : at[k + 1]].tobytes() for k in some], pa.binary())], names=["part", "entries"])

    return run


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries of whole keys -> (key, node, label, probe) of keys with two components or more. The key given is a hash of the
    list of its sets, so keys that hold the same sets are one group, in whichever task they are found."""
    held: dict[int, list[bytes]] = defaultdict(list)
    for batch in batches:
        for part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            held[part].append(blob)
    while held:
        _, blobs = held.popitem()
        e = np.frombuffer(b"".join(blobs), C.U64).reshape(-1, 3)
        order = np.argsort(e[:, 0])  # most keys have one entry, or one component; what is left is small
        key, label = e[order, 0], e[order, 2]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        size = np.diff(np.append(first, len(key)))
        mixed = np.minimum.reduceat(label, first) != np.maximum.reduceat(label, first) if len(first) else np.zeros(0, bool)
        e = e[order[np.repeat(mixed, size)]]
        key, node, probe, label = e[:, 0], e[:, 1] & ~C.U64(1), (e[:, 1] & C.U64(1)).astype(bool), e[:, 2]
        order = np.lexsort((probe, node, key))
        key, node, probe, label = key[order], node[order], probe[order], label[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
        key, node, probe, label = key[new], node[new], probe[new], label[new]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        size = np.diff(np.append(first, len(key)))
        full = np.add.reduceat((~probe).astype(np.int64), first) if len(first) else size
        sign = np.add.reduceat(C.mix(node ^ probe.astype(C.U64)), first) if len(first) else size
        keep = np.flatnonzero(full > 0)
        _, one = np.unique(np.stack([sign[keep].astype(C.U64), size[keep].astype(C.U64)], axis=1), axis=0, return_index=True)
        keep = keep[one]
        rows = C.ranges(first[keep], size[keep])
        name = np.repeat(C.mix(sign[keep].astype(C.U64) + size[keep].astype(C.U64)), size[keep])
        yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (name, node[rows], label[rows])] + [pa.array(probe[rows])], names=["key", "node", "label", "probe"])


def _sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """shingle_sets of a column of compressed texts."""
    of = zstandard.ZstdDecompressor()
    texts, t, h = pa.array([of.decompress(x) if x else b"" for x in column.to_pylist()], pa.binary()), [], []
    for a, _, raw, offsets in C.pieces(texts):
        x, y = shingle_sets(raw, offsets)
        t.append(x + a)
        h.append(y)
    return (np.concatenate(t), np.concatenate(h)) if t else (np.zeros(0, np.int64), np.zeros(0, C.U64))


def linked(inter, size_a, size_b):
    return 100 * inter >= PERCENT * (size_a + size_b - inter)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lead, node, text), sorted so that each leader's own row comes before those of its members -> linked (a, b)."""
    now, leader = None, np.zeros(0, C.U64)
    for whole in batches:
        for i in range(0, len(whole), 512):
            batch = whole.slice(i, 512)
            lead, node = (batch.column(k).to_numpy() for k in (0, 1))
            t, h = _sets(batch.column(2))
            at = np.searchsorted(t, np.arange(len(batch) + 1))
            size = np.diff(at)
            cuts = np.flatnonzero(np.append(True, lead[1:] != lead[:-1]))
            good = np.zeros(len(batch), bool)
            for x, y in zip(cuts, np.append(cuts[1:], len(batch)), strict=True):
                if lead[x] != now or node[x] == lead[x]:
                    now, leader = (lead[x], h[at[x] : at[x + 1]]) if node[x] == lead[x] else (None, leader[:0])
                if not len(leader):
                    continue
                mine = h[at[x] : at[y]]
                hit = leader[np.minimum(np.searchsorted(leader, mine), len(leader) - 1)] == mine
                sums = np.concatenate(([0], np.cumsum(hit)))
                good[x:y] = linked(sums[at[x + 1 : y + 1] - at[x]] - sums[at[x:y] - at[x]], size[x:y], len(leader)) & (node[x:y] != lead[x])
            yield pa.RecordBatch.from_arrays([pa.array(node[good]), pa.array(lead[good])], names=["a", "b"])


def _histogram(h: np.ndarray) -> bytes:
    """Counts of a set's tokens in a power of two of ranges, about four in each; empty if a byte can't hold one."""
    bits = max(4, int(np.ceil(np.log2(max(len(h), 1) / 4))))
    out = np.bincount((C.mix(h) >> C.U64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return out.astype(np.uint8).tobytes() if out.max() < 128 else b""


def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups of (key, block, block, node, label, probe, n, histogram), sorted -> the rows with a partner in another component whose
    size and histogram allow a link: two sets share no more in a range than the smaller count. What is left of a group is named by a hash
    of its sets, so that equal remainders are verified once."""

    def rows_of(rows: list[tuple]) -> list[tuple]:
        rows = sorted({r[3]: r for r in rows}.values(), key=lambda r: r[6])
        n, label, probe = np.array([r[6] for r in rows]), np.array([r[4] for r in rows]), np.array([r[5] for r in rows])
        hist = [np.frombuffer(r[7], np.uint8) for r in rows]
        size = np.array([len(x) for x in hist])
        keep = size == 0
        stack: dict[int, np.ndarray] = {}
        top = np.searchsorted(n, n * 100 // PERCENT, "right")
        for i in range(len(rows)):
            j = np.arange(i + 1, top[i])
            j = j[(label[j] != label[i]) & ~(probe[j] & probe[i])]
            if not len(j):
                continue
            c = int(size[i])
            odd = (size[j] != c) & (size[j] != 2 * c)
            if c == 0 or odd.any():  # no bound
                keep[i] = True
                keep[j[odd] if c else j] = True
                j = j[~odd] if c else j[:0]
            if c not in stack:
                m = np.zeros((len(rows), c), np.uint8)
                for k in np.flatnonzero((size == c) | (size == 2 * c)):
                    m[k] = hist[k] if size[k] == c else hist[k].reshape(-1, 2).sum(axis=1)
                stack = {c: m}
            shared = np.minimum(stack[c][j], stack[c][i]).sum(axis=1, dtype=np.int64) if len(j) else np.zeros(0, np.int64)
            ok = j[linked(shared, n[i], n[j])]
            if len(ok):
                keep[i] = True
                keep[ok] = True
        left = [r for r, k in zip(rows, keep, strict=True) if k]
        sign = C.mix(np.array([r[3] for r in left], np.int64).view(C.U64) ^ np.array([r[5] for r in left], bool).astype(C.U64)).sum(dtype=C.U64)
        name = int(C.mix(np.array([sign + C.U64(len(left))], C.U64)).view(np.int64)[0])
        return [(name, 0, 0, *r[3:6]) for r in left]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        names = ("key", "p", "q", "node", "label", "probe")
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    now, rows, made = None, [], []
    for batch in batches:
        for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if r[:3] != now:
                made += rows_of(rows) if rows else []
                now, rows = r[:3], []
            rows.append(r)
        if made:
            yield out(made)
            made = []
    made += rows_of(rows) if rows else []
    if made:
        yield out(made)


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups of (key, block, block, node, label, probe, text), sorted: links that join different components of a group."""

    def solve(rows: list[tuple]) -> list[tuple[int, int]]:
        rows = list({r[0]: r for r in rows}.values())
        t, h = _sets(pa.array([r[3] for r in rows], pa.binary()))
        at = np.searchsorted(t, np.arange(len(rows) + 1))
        sets = [h[at[i] : at[i + 1]] for i in range(len(rows))]
        home: dict[int, list[int]] = defaultdict(list)
        for i, r in enumerate(rows):
            home[r[1]].append(i)
        todo, out = sorted(home.values(), key=len), []
        done: list[list[int]] = []
        while todo:
            mine = todo.pop(0)  # against every other component that is left, the smallest first
            for k, other in enumerate(todo):
                hit = next(((i, j) for i in mine for j in other if not (rows[i][2] and rows[j][2]) and _near(sets[i], sets[j])), None)
                if hit:
                    out.append((rows[hit[0]][0], rows[hit[1]][0]))
                    todo[k] = other + mine
                    todo.sort(key=len)
                    break
            else:
                done.append(mine)
        return out

    now, rows = None, []
    links: list[tuple[int, int]] = []
    for batch in batches:
        for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if r[:3] != now:
                links += solve(rows) if rows else []
                now, rows = r[:3], []
            rows.append(r[3:])
        if links:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links, strict=True)], names=["a", "b"])
            links = []
    links += solve(rows) if rows else []
    if links:
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links, strict=True)], names=["a", "b"])


def _near(a: np.ndarray, b: np.ndarray) -> bool:
    low, high = sorted((len(a), len(b)))
    if 100 * low < PERCENT * high:
        return False
    i = np.searchsorted(a, b)
    return bool(linked(int((a[np.minimum(i, len(a) - 1)] == b).sum()), len(a), len(b)))


def _leader_pairs(sets: DataFrame) -> DataFrame:
    """(node, lead): sets that agree in a minimum and in a range of sizes, each with the smallest of its group if their sizes allow a link.

    Ranges of ratio 1.6 in two grids: near copies share one range at least.
    """
    grid = F.log(F.col("n").cast("double")) / float(np.log(1.6))
    cells = [F.xxhash64(F.lit(j), F.lit(g), f"m{j}", F.floor(grid + 0.5 * g)) for j in range(MINIMA) for g in (0, 1)]
    each = sets.select("node", "n", F.explode(F.array(*cells)).alias("cell"))
    least = each.groupBy("cell").agg(F.min(F.struct("node", "n")).alias("x"), F.count(F.lit(1)).alias("size")).filter("size > 1").select("cell", F.col("x.node").alias("lead"), F.col("x.n").alias("m"))
    near = (F.col("n") * 100 >= F.col("m") * PERCENT) & (F.col("m") * 100 >= F.col("n") * PERCENT)
    return each.join(least, "cell").filter((F.col("node") != F.col("lead")) & near).select("node", "lead").distinct()


def _led_links(pairs: DataFrame, bodies: DataFrame) -> DataFrame:
    """The linked ones of pairs (node, lead), as (a, b). A leader with many members has copies, so that no task gets them all."""
    spark = pairs.sparkSession
    many = pairs.groupBy("lead").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("copies"))
    salt = F.pmod(F.xxhash64("node"), F.col("copies")).cast("int")
    members = pairs.join(many.filter("copies > 1"), "lead", "left").withColumn("copies", F.coalesce("copies", F.lit(1))).select("node", "lead", salt.alias("salt"))
    leads = many.select(F.col("lead").alias("node"), "lead", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("salt"))
    rows = members.unionByName(leads).join(bodies.select("node", "z"), "node")
    dealt = rows.repartition(C.shuffle_partitions(spark), "lead", "salt").sortWithinPartitions("lead", "salt", F.col("node") != F.col("lead"))
    return dealt.select("lead", "node", "z").mapInArrow(C.lean(_verify), "a long, b long")


def ngram_join(docs: DataFrame, rare_most: int = RARE_MOST) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs: the smallest doc_id reachable by links, its own included.

    docs: doc_id, text (other columns are ignored). Words are lower-cased (A-Z) runs without ASCII white space; a text of fewer than five words is one
    shingle. Null, empty and blank texts have no shingle and link with nothing; they keep their own doc_id. Equal sets, repeated rows
    included, link. A null doc_id stays and is never a component's smallest unless all are null. An empty table gives an empty result.
    A very long text is a set like any other, held whole by one task at a time. Sets stand for their 63-bit hashes.
    No pair, link or component is collected; the driver holds the sketch alone.
    rare_most: tokens that the sketch counts in more different sets than this are the frequent class.
    """
    spark = docs.sparkSession
    name = f"ngram_join_{uuid.uuid4().hex}"
    folder, parts = f"{C.shared_folder(spark)}/{name}", C.shuffle_partitions(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    try:
        texts.mapInArrow(C.lean(_describe), _TABLE).repartition(parts, "bk").write.partitionBy("kind").bucketBy(parts, "bk").option("path", folder).saveAsTable(name)
        table = spark.table(name)
        out = C.checkpointed(_joined(spark, table, parts, rare_most))
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        C.remove_folder(spark, folder)
    return out


def _joined(spark, table: DataFrame, parts: int, rare_most: int) -> DataFrame:
    rows = table.filter(F.col("kind") == DOC).select("doc_id", F.col("m0").alias("node"), "n")
    # a set is there once for each task that met it; buckets are by it, so this exchanges nothing
    bodies = table.filter(F.col("kind") == SET).groupBy(F.col("bk").alias("node")).agg(*(F.first(c).alias(c) for c in ("n", "z", "hist", *(f"m{j}" for j in range(MINIMA)))))
    levels, mean = _sketch(table.filter(F.col("kind") == COUNTS))
    frequent = int(np.frexp(rare_most + mean)[1])
    sketch = spark.sparkContext.broadcast(levels)
    pairs = C.checkpointed(_leader_pairs(bodies.select("node", "n", *(f"m{j}" for j in range(MINIMA)))))
    links = C.checkpointed(_led_links(pairs, bodies))
    label = components(links)
    indexed = bodies.select("node", "z").join(label, "node", "left").select("node", F.coalesce("label", "node").alias("label"), "z")
    entries = indexed.mapInArrow(C.lean(_index(sketch, frequent, 2 * parts)), "part int, entries binary")
    groups = entries.repartition(2 * parts, "part").mapInArrow(C.lean(_groups), "key long, node long, label long, probe boolean")
    marked = C.checkpointed(groups.dropDuplicates(["key", "node"]))
    # each set against one of its key's that is of another component: most links that are left show there, once for each pair
    first = marked.groupBy("key").agg(F.min(F.struct("probe", F.xxhash64("node"), "node", "label")).alias("x")).select("key", F.col("x.node").alias("lead"), F.col("x.label").alias("other"))
    pairs = marked.join(first, "key").filter("label <> other").select("node", "lead").distinct()
    size_a, size_b = (bodies.select(F.col("node").alias(k), F.col("n").alias(f"n_{k}")) for k in ("node", "lead"))
    near = (F.col("n_node") * 100 >= F.col("n_lead") * PERCENT) & (F.col("n_lead") * 100 >= F.col("n_node") * PERCENT)
    pairs = C.checkpointed(pairs.join(size_a, "node").join(size_b, "lead").filter(near).select("node", "lead"))
    links = C.checkpointed(links.unionByName(_led_links(pairs, bodies)))
    label = components(links)
    marked = marked.drop("label").join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    sizes = marked.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y").select("key", "size")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("node"), blocks).cast("int")
    rest = marked.join(sizes, "key").withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rest = rest.select("key", F.least("mine", "other").alias("p"), F.greatest("mine", "other").alias("q"), "node", "label", "probe")
    group = ["key", "p", "q"]
    rest = rest.join(bodies.select("node", "n", "hist"), "node").select(*group, "node", "label", "probe", "n", "hist").repartition(parts, *group).sortWithinPartitions(*group)
    rest = C.checkpointed(rest.mapInArrow(C.lean(_possible), "key long, p int, q int, node long, label long, probe boolean").dropDuplicates(["key", "node"]))
    rest = rest.join(bodies.select("node", "z"), "node").select(*group, "node", "label", "probe", "z").repartition(parts, *group).sortWithinPartitions(*group)
    more = C.checkpointed(rest.mapInArrow(C.lean(_exact), "a long, b long"))
    if not more.isEmpty():
        label = components(links.unionByName(more))
    whole = rows.join(label, "node", "left").withColumn("part", F.coalesce("label", "node"))
    least = whole.filter("n > 0").groupBy("part").agg(F.min("doc_id").alias("component_id"))
    some = whole.filter("n > 0").join(least, "part").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return some.unionByName(whole.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is their component's smallest; rows with a null doc_id stay."""
    first = ngram_join(docs).filter("doc_id = component_id").select("doc_id").distinct()
    return docs.join(first, "doc_id", "left_semi").select(docs.columns).unionByName(docs.filter("doc_id is null"))
