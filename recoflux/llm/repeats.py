"""Repeated windows across a corpus: what suffix-array and substring removal share.

A window is `window` consecutive units (bytes or words) of one text; the task is to find every window that also
starts somewhere else. No group of all pairs and no index of all suffixes is shuffled:

1. equal texts are collapsed (a text with copies is repeated as a whole);
2. every window picks its smallest `gram`-unit hash, a choice that depends on its content alone, so equal windows pick
   the same offset. Windows in a row with one choice and one offset class share a core of window - width + 1 units; one row
   (hash of the core, text, first and last start) stands for all of them;
3. cores that occur once are pruned by a pre-aggregated count; only the stretches around the others are sent, by core, to
   shards of bounded size, each searched by the operator's own index (a suffix array or a suffix tree);
4. the starts it finds go back to the texts.

A core with over `hot` rows is sent as narrower classes, whose cores are almost whole windows, so that a hot core is
spread over many shards. Narrow classes need not nest in the wide ones: each is cut to the hot runs that it overlaps.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

_POS = (1 << 24) - 1
TILE = 1 << 19
SALTS = 32


@dataclass(frozen=True)
class Plan:
    """units: (bytes, offsets) -> (hash of each unit, unit offsets, raw units); search: shard -> starts to mark."""

    window: int
    gram: int
    width: int
    hot_width: int
    units: Callable
    search: Callable
    hot: int = 20_000
    shard_units: int = 1 << 21


def core_runs(values: np.ndarray, offsets: np.ndarray, window: int, gram: int, width: int):
    """(text, first start, last start, core hash) of each run of windows with one smallest gram and one offset class."""
    out, n = [], len(values)
    reach = window - gram + 1
    ends = offsets[1:]
    for t in range(0, max(0, n - window + 1), TILE):
        v = values[t : t + TILE + window - 1]
        sums = C.prefix_sums(v)
        k = np.arange(len(v) - gram + 1)
        h = C.span_hash(sums, k, k + gram)
        h &= ~C.U64(_POS)
        h |= (_POS - k).astype(C.U64)
        m = C.sliding_min(h, reach)
        pos = _POS - (m & C.U64(_POS)).astype(np.int64)
        s = np.arange(len(m))
        text = np.searchsorted(offsets, s + t, "right") - 1
        ok = s + t + window <= ends[np.minimum(text, len(ends) - 1)]
        s, pos, text = s[ok], pos[ok], text[ok]
        if not len(s):
            continue
        kind = (pos - s) // width
        new = np.ones(len(s), bool)
        new[1:] = (pos[1:] != pos[:-1]) | (kind[1:] != kind[:-1])
        a = np.flatnonzero(new)
        b = np.append(a[1:], len(s)) - 1
        p, kind = pos[a], kind[a]
        begin = p - kind * width  # the last start of the class, so that all its windows have begin ... begin - width + window
        out.append((text[a], s[a] + t - offsets[text[a]], s[b] + t - offsets[text[a]], C.span_hash(sums, begin, begin - width + 1 + window) ^ kind.astype(C.U64) * C.U64(0x9E3779B97F4A7C15)))
    if not out:
        z = np.zeros(0, np.int64)
        return z, z, z, z.astype(C.U64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _rows(plan: Plan, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = (batch.column(i).to_numpy() for i in (0, 1))
            for a, _, raw, offsets in C.pieces(batch.column(2)):
                values, at, _ = plan.units(raw, offsets)
                text, first, last, core = core_runs(values, at, plan.window, plan.gram, width)
                yield pa.RecordBatch.from_arrays([pa.array(core.view(np.int64)), pa.array(k1[a + text]), pa.array(k2[a + text]), pa.array(first << 16 | last - first)], names=["core", "k1", "k2", "at"])

    return run


def _stretches(plan: Plan):
    """(k1, k2, text, list of (core, at, n)) -> the units of each run, by core; a hot core's windows by narrower ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, len(whole), 64):
                batch = whole.slice(i, 64)
                k1, k2 = (batch.column(j).to_numpy() for j in (0, 1))
                lists = batch.column(3)
                for a, b, raw, offsets in C.pieces(batch.column(2)):
                    values, at, units = plan.units(raw, offsets)
                    part = lists.slice(a, b - a)
                    flat, n = part.flatten(), part.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                    text = np.repeat(np.arange(b - a), n)
                    core, pos, count = (flat.field(j).to_numpy() for j in range(3))
                    first, last, hot = pos >> 16, (pos >> 16) + (pos & 0xFFFF), count > plan.hot
                    got = [(core[~hot], text[~hot], first[~hot], last[~hot])]
                    if hot.any():
                        t2, f2, l2, c2 = core_runs(values, at, plan.window, plan.gram, plan.hot_width)
                        # a narrow run may straddle two wide ones: each hot wide run that it overlaps takes its own part of it
                        order = np.argsort(text[hot] << 32 | first[hot])
                        f1, l1 = first[hot][order], last[hot][order]
                        lo = np.searchsorted(text[hot][order] << 32 | l1, t2 << 32 | f2)
                        many = np.maximum(np.searchsorted(text[hot][order] << 32 | f1, t2 << 32 | l2, "right") - lo, 0)
                        k, w = np.repeat(np.arange(len(t2)), many), C.ranges(lo, many)
                        got.append((c2.view(np.int64)[k], t2[k], np.maximum(f2[k], f1[w]), np.minimum(l2[k], l1[w])))
                    core, text, first, last = (np.concatenate(x) for x in zip(*got, strict=True))
                    begin, size = at[text] + first, last - first + plan.window
                    step = max(1, (4 << 20) // (plan.window * 2 * units.itemsize))
                    for j in range(0, len(core), step):
                        q = slice(j, j + step)
                        data = units[C.ranges(begin[q], size[q])].tobytes()
                        ends = np.concatenate(([0], np.cumsum(size[q]) * units.itemsize)).astype(np.int32)
                        column = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data)])
                        yield pa.RecordBatch.from_arrays([pa.array(core[q]), pa.array(k1[a + text[q]]), pa.array(k2[a + text[q]]), pa.array(first[q].astype(np.int64)), column], names=["core", "k1", "k2", "first", "units"])

    return run


def _marks(plan: Plan, itemsize: int):
    """Stretches sorted by core -> runs of repeated starts; a shard is some whole cores of about shard_units units."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        merged: dict[tuple, set[tuple]] = {}
        for core, k1, k2, first, units in rows:
            merged.setdefault((core, units), set()).add((k1, k2, first))
        stretches = [units for _, units in merged]
        out: list[tuple] = []
        whole = {i for i, who in enumerate(merged.values()) if len(who) > 1}
        found = plan.search(stretches) if len(whole) < len(stretches) else {}
        for i, ((_, units), who) in enumerate(merged.items()):
            last = len(units) // itemsize - plan.window
            for a, b in [(0, last)] if i in whole else found.get(i, ()):
                out += [(k1, k2, first + a, first + b) for k1, k2, first in who]
        cols = list(zip(*out, strict=True)) if out else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], names=["k1", "k2", "first", "last"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held, last = 0, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != last and held > plan.shard_units * itemsize:
                    yield solve(rows)
                    rows, held = [], 0
                last = row[0]
                held += len(row[4])
                rows.append(row)
        if rows:
            yield solve(rows)

    return run


def repeated_starts(texts: DataFrame, plan: Plan, itemsize: int) -> DataFrame:
    """(k1, k2, first, last): runs of starts of repeated windows in texts (k1, k2, text), one row per distinct text."""
    rows = texts.select("k1", "k2", "text").mapInArrow(_rows(plan, plan.width), "core long, k1 long, k2 long, at long")
    # a core may hold a third of all rows: its count is joined back by core and salt, for the salts that its rows have
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("k1"), F.lit(SALTS)).cast("int"))
    often = rows.groupBy("core").agg(F.count(F.lit(1)).alias("n"), F.bit_or(F.expr("shiftleft(1L, salt)")).alias("salts")).filter("n > 1")
    each = F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda i: F.getbit("salts", i) == 1)
    often = often.select("core", "n", F.explode(each).alias("salt"))
    lists = rows.join(often, ["core", "salt"]).groupBy("k1", "k2").agg(F.collect_list(F.struct("core", "at", "n")).alias("runs"))
    held = texts.join(lists, ["k1", "k2"]).select("k1", "k2", "text", "runs")
    sent = held.mapInArrow(_stretches(plan), "core long, k1 long, k2 long, first long, units binary")
    shards = sent.repartition(C.shuffle_partitions(texts.sparkSession), "core").sortWithinPartitions("core")
    return shards.mapInArrow(_marks(plan, itemsize), "k1 long, k2 long, first long, last long")


def remove_repeats(docs: DataFrame, plan: Plan, itemsize: int, cut: Callable, schema: str) -> DataFrame:
    """doc_id with the columns that `cut` makes of (text, whether it has copies, runs of marked starts), one row per row of docs."""
    keyed = docs.select("doc_id", "text", *C.text_key(F.col("text")))
    texts = keyed.groupBy("k1", "k2").agg(F.first(F.coalesce("text", F.lit(""))).alias("text"))
    copies = keyed.groupBy("k1", "k2").agg((F.count(F.lit(1)) > 1).alias("copied"))
    marks = repeated_starts(texts, plan, itemsize).groupBy("k1", "k2").agg(F.collect_list(F.struct("first", "last")).alias("marks"))
    done = texts.join(marks, ["k1", "k2"], "left").join(copies, ["k1", "k2"]).select("k1", "k2", "text", "copied", "marks")
    made = done.mapInArrow(cut, f"k1 long, k2 long, {schema}")
    return keyed.select("doc_id", "k1", "k2").join(made, ["k1", "k2"]).drop("k1", "k2")


def covered(marks: list | None, window: int) -> list[tuple[int, int]]:
    """Maximal runs [a, b) of units covered by the windows that start in the marked runs."""
    out: list[list[int]] = []
    for a, b in sorted((m["first"], m["last"] + window) for m in marks or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]
