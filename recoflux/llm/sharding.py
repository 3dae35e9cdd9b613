"""Sharding by histogram sort.

Rows are ordered by (hash of the text, doc_id). Boundaries are found without sorting: each round counts, exactly and with one
pre-aggregated pass over the keys, the bytes below evenly spaced probes inside the intervals that still hold a boundary, and narrows
them until a probe is within tolerance of its target; a boundary only falls inside a group of equal texts when the group is wider than that.
Then the rows are exchanged once, by those boundaries.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

BITS = 8  # of key that a round resolves in each open interval
TOTAL_BITS = 128
FINE = 8  # exchange partitions of a shard


@dataclass(frozen=True)
class Cut:
    """A boundary: the least (hash, id), as 128-bit unsigned number, on its right."""

    key: int

    def parts(self) -> tuple[int, int]:
        return (self.key >> 64) - (1 << 63), (self.key & (1 << 64) - 1) - (1 << 63)


def _prefix(depth: int) -> tuple[Column, ...]:
    """The first `depth` bits of the key as columns (upper 64, lower 64), each shifted to sort as unsigned."""
    flip = lambda c: F.col(c).bitwiseXOR(F.lit(-(1 << 63)))
    if depth <= 64:
        return (F.shiftrightunsigned(flip("h"), 64 - depth) if depth else F.lit(0).cast("long"),)
    return flip("h"), F.shiftrightunsigned(flip("i"), 128 - depth)


def _unsigned(x: int) -> int:
    return x + (1 << 64) if x < 0 else x


def find_cuts(keys: DataFrame, n: int, tolerance: float) -> list[Cut]:
    """n - 1 boundaries that part keys (h, i, size) into n runs of near equal size; no pass collects over n * 2 ** BITS rows.

    First on h alone; an interval with one h is set aside, and split by i after that only if its edges are too far from the target.
    """
    total = keys.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    if not total:
        return [Cut(0)] * (n - 1)
    goal = [total * k / n for k in range(1, n)]
    slack = tolerance * total / n
    cut: dict[int, int] = {}
    aside: dict[int, tuple[int, list[int]]] = {}
    open_: dict[int, tuple[int, list[int]]] = {0: (0, list(range(n - 1)))}  # prefix -> size below, targets
    depth = 0
    while open_ or aside:
        if not open_:
            open_, aside, depth = aside, {}, 64
        new = depth + BITS
        near = keys if not depth else _inside(keys, depth, list(open_))
        flat = [F.min("h"), F.max("h"), F.min("i"), F.max("i")]
        rows = near.groupBy(*(c.alias(f"p{j}") for j, c in enumerate(_prefix(new)))).agg(F.sum("size").alias("size"), *flat).collect()
        bins: dict[int, list[tuple]] = {}
        for r in rows:
            full = _unsigned(r[0]) if new <= 64 else _unsigned(r[0]) << (new - 64) | _unsigned(r[1])
            bins.setdefault(full >> BITS, []).append((full, *r[-5:]))
        after: dict[int, tuple[int, list[int]]] = {}
        for prefix, (below, targets) in open_.items():
            at, edges, inside = below, [], {}
            for full, size, h0, h1, i0, i1 in sorted(bins[prefix]):
                edges.append((full, at))
                inside[full] = (at, h0 if h0 == h1 else None, h0 == h1 and i0 == i1)
                at += size
                edges.append((full + 1, at))
            for t in targets:
                key, size = min(edges, key=lambda e: abs(e[1] - goal[t]))
                full = max((k for k in inside if inside[k][0] <= goal[t]), default=min(inside))
                start, one, single = inside[full]
                if abs(size - goal[t]) <= slack or single or new >= TOTAL_BITS:
                    cut[t] = key << (TOTAL_BITS - new)
                elif new < 64 and one is not None:
                    aside.setdefault(one + (1 << 63), (start, []))[1].append(t)
                else:
                    after.setdefault(full, (start, []))[1].append(t)
        open_, depth = after, new
        if depth == 64 and open_:  # whole values of h
            aside |= open_
            open_ = {}
    return [Cut(min(cut[t], (1 << TOTAL_BITS) - 1)) for t in range(n - 1)]


def _inside(keys: DataFrame, depth: int, prefixes: list[int]) -> DataFrame:
    cols = _prefix(depth)
    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    if len(cols) == 1:
        return keys.filter(cols[0].isin([signed(p) for p in prefixes]))
    by: dict[int, list[int]] = {}
    for p in prefixes:
        by.setdefault(p >> (depth - 64), []).append(p & (1 << depth - 64) - 1)
    some = F.lit(False)
    for up, lows in by.items():
        some |= (cols[0] == signed(up)) & cols[1].isin([signed(x) for x in lows])
    return keys.filter(some)


def _part(cuts: list[Cut]) -> Column:
    """How many cuts are at or below (h, i): a balanced tree of comparisons on literals."""

    def tree(a: int, b: int) -> Column:
        if a == b:
            return F.lit(a)
        m = (a + b) // 2
        up, low = cuts[m].parts()
        low = max(low, -(1 << 63))
        right = (F.col("h") > up) | ((F.col("h") == up) & (F.col("i") >= low))
        return F.when(right, tree(m + 1, b)).otherwise(tree(a, m))

    return tree(0, len(cuts))


def shard_by_bytes(docs: DataFrame, n_shards: int = 24, tolerance: float = 0.002) -> DataFrame:
    """Deals all rows of docs to n_shards shards of near equal bytes (text bytes + 8 a row; null: 8).

    Returns doc_id, size, text_crc32, law ('bytes'), shard, slot (gapless from 0 in the order of text hash, doc_id) and grown_shard (null).
    Equal texts stay together unless their group is wider than the tolerance. Rows with equal text and doc_id, null ids included, always
    stay together. An empty table gives an empty result. Only doc_id and text are read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    keys = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.lit(3), text).alias("h"), F.coalesce(F.xxhash64("doc_id"), F.lit(0)).alias("i"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    keys = checkpointed(keys)
    cuts = find_cuts(keys.select("h", "i", "size"), n_shards * FINE, tolerance * FINE)
    fine = keys.withColumn("fine", _part(cuts))
    counts = {r.fine: r.n for r in fine.groupBy("fine").agg(F.count(F.lit(1)).alias("n")).collect()}
    before, at = [], 0
    for k in range(n_shards * FINE):
        at = 0 if k % FINE == 0 else at
        before.append(at)
        at += counts.get(k, 0)
    offset = F.element_at(F.array(*(F.lit(x).cast("long") for x in before)), F.col("fine") + 1)
    place = F.row_number().over(Window.partitionBy("fine").orderBy("h", "i", "doc_id", "size"))
    return fine.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.floor(F.col("fine") / FINE).cast("int").alias("shard"), (place - 1 + offset).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))

